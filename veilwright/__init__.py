"""Spark-native analytics for transcript anonymisation and its evaluation."""
