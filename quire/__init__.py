"""Spark-native document QA analytics engine."""
