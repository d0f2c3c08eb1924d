"""Spark-native record-linkage, tabulation and disclosure-audit engine."""
