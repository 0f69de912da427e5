"""Cleaning rules as column expressions."""
