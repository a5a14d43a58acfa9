"""The same operators over unbounded event streams, with Structured Streaming."""
