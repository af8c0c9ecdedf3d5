"""Scans: tables of the corpus and the raw source formats."""
