"""Kelvara: document analytics for engineering texts as declarative Spark plans."""

__version__ = "0.1.0"
