"""Spark-native retrieval, fact and rule analytics."""
