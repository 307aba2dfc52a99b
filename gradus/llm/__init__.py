"""Training-data pipeline operators; each module is independent of the rest of the library's operators."""
