"""Structured Streaming: extensions beyond the batch operators."""
