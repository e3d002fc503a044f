"""Sinks of the table engine."""
