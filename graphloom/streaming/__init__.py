"""Change feeds and usage counters on Structured Streaming."""
