"""Structured Streaming versions of the ledger jobs."""
