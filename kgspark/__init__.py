"""Spark-native toolkit for deterministic, auditable knowledge graphs."""
