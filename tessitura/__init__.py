"""Tessitura: a PySpark-native engine for chord-sequence corpora."""

__version__ = "0.1.0"
