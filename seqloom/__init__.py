"""Spark-native sequence-graph analytics."""
