"""Event-time and metric operators, batch and Structured Streaming."""
