"""Scans, fetches and sinks."""
