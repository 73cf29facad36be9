"""Structured Streaming form of the cart fold."""
