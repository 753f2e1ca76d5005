"""Scans: files and JSON payloads to tables."""
