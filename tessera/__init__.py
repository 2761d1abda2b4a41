"""Tessera: a PySpark-native engine for media-segment catalogues, timelines and text corpora."""
