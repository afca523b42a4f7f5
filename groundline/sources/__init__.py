"""Readers and writers of reports: pages, embedded and side graphs, core tables."""
