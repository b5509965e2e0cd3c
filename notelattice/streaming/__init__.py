"""Structured Streaming forms of sync and edits, over append-only versioned tables."""
