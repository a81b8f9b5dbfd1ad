"""Spark-native point-in-time analytics: snapshots, markets, scoring."""
