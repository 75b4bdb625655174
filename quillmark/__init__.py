"""Spark-native dataset profiling, knowledge records and hybrid retrieval."""
