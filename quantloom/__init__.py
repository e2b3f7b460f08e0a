"""Trading-strategy analytics as Spark jobs."""
