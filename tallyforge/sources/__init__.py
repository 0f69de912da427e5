"""Readers and writers of order files."""
