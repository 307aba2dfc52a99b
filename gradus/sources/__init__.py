"""gradus.sources."""
