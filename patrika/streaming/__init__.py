"""Streams of documents. An extension: the flows themselves are batch work."""
