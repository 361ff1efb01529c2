"""Spark-native interval, timeline and evidence analytics."""
