"""Online operators on Structured Streaming."""
