"""Spark-native phylogenetic and community analytics, and training-data operators."""
