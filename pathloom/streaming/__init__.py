"""Structured Streaming: journal replay, rename pairing, versioned publication."""
