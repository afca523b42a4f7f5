"""Composing a report into one script, and running it."""
