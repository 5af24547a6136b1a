"""Training-data operators over text and vector tables, one module each."""
