"""Backline: a PySpark-native engine for live-event analytics."""
