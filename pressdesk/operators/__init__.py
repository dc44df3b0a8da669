"""Parsing, extraction, hits and reports."""
