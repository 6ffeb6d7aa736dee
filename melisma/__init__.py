"""Melisma: a Spark-native text retrieval and corpus engine."""
