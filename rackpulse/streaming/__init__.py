"""The polling loops as Structured Streaming queries."""
