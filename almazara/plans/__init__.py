"""Registered queries, their SQL counterparts and the staged pipeline."""
