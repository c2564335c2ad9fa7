"""Structured Streaming over captures, an extension."""
