"""Operators of a training-data pipeline (mixing, packing, filters, de-duplication, search)."""
