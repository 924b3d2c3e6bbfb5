"""Spark-native two-source reconciliation and record linkage."""
