"""Keep tables current from change logs, as Spark DataFrame and Structured Streaming jobs."""
