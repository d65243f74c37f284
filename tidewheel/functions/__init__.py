"""Functions on columns, and codecs."""
