"""Spark-native engine for public-finance open data."""
