"""Log analytics as batch and Structured Streaming."""
