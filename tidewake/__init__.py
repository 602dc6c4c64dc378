"""Spark-native analytics over time-stamped log and event streams."""
