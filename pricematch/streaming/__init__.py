"""The collect-and-match cycle as Structured Streaming."""
