"""The same run views on Structured Streaming."""
