"""Readers, sinks and the fixed dimension maps."""
