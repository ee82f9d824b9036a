"""Operators over page, region, word and excerpt tables."""
