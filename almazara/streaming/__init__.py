"""Structured Streaming variants of the additive daily aggregates."""
