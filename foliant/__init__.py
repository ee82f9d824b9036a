"""Document-structure analytics on Spark: page regions and OCR words in, tables of contents and articles out."""
