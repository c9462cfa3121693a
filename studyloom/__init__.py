"""Spark-native study-operations analytics: calendar, ledger, topics, costs, retrieval."""
