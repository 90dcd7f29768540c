"""The same operators over Structured Streaming, by micro-batch."""
