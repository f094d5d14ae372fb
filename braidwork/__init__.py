"""Spark-native analytics over sequences, graphs, intervals and run reports."""
