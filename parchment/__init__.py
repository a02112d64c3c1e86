"""Document-extraction analytics on Spark."""
