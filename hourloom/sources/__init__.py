"""Scans, sinks and payload readers."""
