"""Replies as they arrive."""
