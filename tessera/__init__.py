"""Tessera: a Spark-native engine for citable engineering context."""
