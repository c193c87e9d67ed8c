"""Spark-native analytics over web-crawl tables."""
