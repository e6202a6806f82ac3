"""Operators of a training-data pipeline: text extraction, fingerprints, filters, joins, packing, sharding, counting."""
