"""Structured Streaming: keyed processors and pipelines."""
