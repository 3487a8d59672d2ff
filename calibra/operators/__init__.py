"""Table-level operators (joins, aggregations, windows, statistics)."""
