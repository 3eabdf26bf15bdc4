"""Readers and writers: delimited text, fitted models, shared working tables."""
