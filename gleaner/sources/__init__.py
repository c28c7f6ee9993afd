"""Readers and writers: CSV, JSON hits, landed HTML pages and run state."""
