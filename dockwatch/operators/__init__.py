"""Reusable DataFrame-to-DataFrame operators with explicit skew behaviour."""
