"""Incremental landing of chunked payload files."""
