"""Call-audio risk analytics on Spark DataFrames and Structured Streaming."""

__version__ = "0.1.0"
