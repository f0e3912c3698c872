"""Equipment reliability analytics as Spark DataFrame jobs."""
