"""A Spark-native engine for position-indexed variant tables and for star-schema tables mapped onto the same operators."""
