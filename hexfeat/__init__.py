"""Spark-native geospatial feature engine: every operator takes and returns DataFrames."""
