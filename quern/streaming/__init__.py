"""Structured Streaming forms of the activity queries."""
