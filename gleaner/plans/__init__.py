"""Whole feeds built from the operators, and the jobs that run them on files."""
