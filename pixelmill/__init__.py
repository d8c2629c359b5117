"""Spark-native land-cover analytics: rasters are pixel tables, every operator is a DataFrame plan."""
