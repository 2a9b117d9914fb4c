"""Analytics of drifting particles, in PySpark."""
