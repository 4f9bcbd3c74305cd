"""The operators on endless logs, with Structured Streaming."""
