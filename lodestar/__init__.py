"""lodestar: similarity search and identification as Spark DataFrame jobs."""
