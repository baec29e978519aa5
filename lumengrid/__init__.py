"""Spark-native analytics over gridded data: frames, pixels, ordered series, and batch phase retrieval."""
