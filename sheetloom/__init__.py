"""Sheetloom: production-sheet analytics and record linkage as Spark plans."""

__version__ = "0.1.0"
