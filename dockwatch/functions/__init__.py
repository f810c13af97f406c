"""Pure Column builders; nothing here triggers a job."""
