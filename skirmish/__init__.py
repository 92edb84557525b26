"""Battle-log analytics as Spark DataFrame jobs."""
