"""Streams of tokens assembled to sentences."""
