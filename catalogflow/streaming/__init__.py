"""Structured Streaming twins of the windowed operators; state is bounded by watermarks."""
