"""Spark-native scanning and analytics over source code and text corpora."""
