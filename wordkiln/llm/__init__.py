"""Operators of a training-data pipeline: scoring, deduplication, rules, packing, mixing, sharding, WARC, fingerprints."""
