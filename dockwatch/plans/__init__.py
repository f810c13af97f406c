"""Business questions composed from operators; one function per question."""
