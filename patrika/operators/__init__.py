"""Operators on rows of documents and pages."""
