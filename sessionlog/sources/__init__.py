"""Readers that produce the canonical events / sessions tables."""
