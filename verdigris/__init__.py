"""Spark-native retrieval, belief-graph and text-analytics engine."""
