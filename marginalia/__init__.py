"""Spark-native retrieval and corpus-processing engine."""
