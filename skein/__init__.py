"""Spark-native web-text retrieval, ranking, link analysis and duplicate detection."""
