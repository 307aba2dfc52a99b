"""gradus.streaming."""
