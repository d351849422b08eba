"""Recurring loads as streams over a landing folder."""

from serieslake.streaming.incremental import stream_append_new

__all__ = ["stream_append_new"]
