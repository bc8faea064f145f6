"""Incremental landing of delimited feeds (Structured Streaming)."""

from .landing import land_feed

__all__ = ["land_feed"]
