"""Position-bounded reading analytics on Spark."""
