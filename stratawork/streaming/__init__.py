"""Structured Streaming loads."""

from .merge import stream_merge

__all__ = ["stream_merge"]
