"""Scalar functions: text and id cleaning, geometry, similarity."""
