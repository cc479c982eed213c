"""Document tables and service usage analytics as Spark DataFrame jobs."""
