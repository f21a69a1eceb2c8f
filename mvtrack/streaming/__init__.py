"""Structured Streaming variants of the stateful operators."""
