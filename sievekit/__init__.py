"""Spark-native spam/ham message analytics: sources, text functions, features, models, evaluation."""
