"""Spark-native operators for map, path, edit-log and telemetry tables."""
