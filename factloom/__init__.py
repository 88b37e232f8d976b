"""Spark-native evidence-graph and corpus analytics."""
