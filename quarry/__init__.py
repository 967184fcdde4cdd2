"""quarry: structural analytics over code and text corpora, written for Spark."""

__version__ = "0.1.0"
