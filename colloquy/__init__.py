"""Exchange analytics on Spark."""
