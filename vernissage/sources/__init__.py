"""Scans, sinks and work lists."""
