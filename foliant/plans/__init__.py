"""Queries over the test tables: adapters that make pages, regions and words of them, and the SQL to hold against."""
