"""Kinfold: leakage-safe, group-aware evaluation of tabular models as Spark jobs."""
