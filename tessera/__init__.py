"""Spark-native text curation and semantic-map analytics."""
