"""Linking of documents that arrive as a stream."""
