"""Almazara: a Spark-native engine for cleaning, integrating and forecasting operational demand data."""

__version__ = "0.1.0"
