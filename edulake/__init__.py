"""Training-data and model-evaluation analytics as ordinary Spark DataFrame and Structured Streaming jobs."""
