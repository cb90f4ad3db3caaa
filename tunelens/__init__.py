"""Streaming-ML tuning analytics expressed as Spark DataFrame jobs."""
