"""Batch and file-stream jobs that build and query a passage store on Spark."""
