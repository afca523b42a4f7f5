"""Scanners for SQL text, expressions, numbers and JSON; row functions and their Spark forms."""
