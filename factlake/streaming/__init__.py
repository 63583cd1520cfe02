"""The change feed and derived state on Structured Streaming."""
