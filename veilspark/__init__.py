"""Spark-native document privacy and risk analytics."""
