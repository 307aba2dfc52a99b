"""gradus.plans."""
