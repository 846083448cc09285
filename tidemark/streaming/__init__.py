"""Continuous ingest (an extension: the store itself takes batches)."""

from .ingest import stream_into

__all__ = ["stream_into"]
