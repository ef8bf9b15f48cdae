"""Spark-native retrieval, knowledge-graph and corpus analytics."""
