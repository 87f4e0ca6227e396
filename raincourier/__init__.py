"""Delivery analytics under rain, as Spark DataFrame and Structured Streaming jobs."""
