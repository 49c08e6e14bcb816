"""Text representation analytics on Spark."""
