"""gradus.operators."""
