"""Spark-native analytics for dynamic networks: tensors as long tables, posteriors as queries."""
