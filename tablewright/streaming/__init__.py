"""Streaming refresh of tables."""

from .refresh import append_stream, refresh_stream

__all__ = ["append_stream", "refresh_stream"]
