"""Support-ticket search and its evaluation as Spark DataFrame jobs."""
