"""Document records on Spark."""
