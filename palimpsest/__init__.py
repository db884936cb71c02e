"""Palimpsest: a PySpark-native engine for analysing versions of byte objects."""
