"""Spark-native engine for structured binary files and the tables derived from them."""
