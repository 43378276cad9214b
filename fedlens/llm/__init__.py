"""Operators for preparing training text: counting, filtering, deduplicating, scoring and packing documents."""
