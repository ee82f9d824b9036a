"""Training-data operators: tokenising, filtering, near-duplicate search, sharding and scanning of text corpora."""
