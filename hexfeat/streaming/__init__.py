"""Structured Streaming: detection stream, gates and the incident state machine."""
