"""Spark-native rule mining and analytics over labelled tables and text."""
