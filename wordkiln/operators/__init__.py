"""Transforms of whole tables."""
