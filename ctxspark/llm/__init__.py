"""Operators for preparing training data: formatting, cleaning, deduplicating, packing and scoring documents."""
