"""Readers and writers."""

from millrace.sources import infer, readers, writers

__all__ = ["infer", "readers", "writers"]
