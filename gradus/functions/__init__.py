"""gradus.functions."""
