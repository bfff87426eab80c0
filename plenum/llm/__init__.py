"""Operators for preparing training corpora: deduplication, quality, PII, packing, sharding."""
