"""Validation, cross rules, trace and reviewer analytics."""
