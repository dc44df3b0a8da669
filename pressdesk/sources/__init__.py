"""Landed pages, derived pages and outputs."""
