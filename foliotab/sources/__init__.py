"""Readers, text parsers and writers."""
