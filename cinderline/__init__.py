"""Spark-native claims, places and proximity analytics on DataFrames."""
