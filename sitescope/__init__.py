"""Explainable, location-based multi-criteria analysis on PySpark."""
