"""Readers, sinks and the index store."""
