"""Readers and writers of graph files and tables."""
