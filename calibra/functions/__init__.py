"""Column-level building blocks: parsing, metrics aggregates, statistics."""
