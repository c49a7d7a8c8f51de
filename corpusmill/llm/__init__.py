"""Training-data operators for text. Nothing outside this package imports it."""
