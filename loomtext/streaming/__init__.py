"""Patterns over streams of text chunks."""

from .chunks import Feed, scan_chunks

__all__ = ["Feed", "scan_chunks"]
