"""The hourly pipeline as Structured Streaming."""
