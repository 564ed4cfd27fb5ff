"""Spark-native KPI investigation and data-quality engine."""
