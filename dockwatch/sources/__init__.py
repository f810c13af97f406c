"""Readers: history files, landed snapshot files, nested station records."""
