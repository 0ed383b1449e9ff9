"""Operators for preparing training text: filtering, deduplication, mixing, packing, export."""
