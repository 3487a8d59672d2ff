"""Query registry, oracle SQL and the audit pipeline."""
