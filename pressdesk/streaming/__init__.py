"""Extraction as pages land."""
