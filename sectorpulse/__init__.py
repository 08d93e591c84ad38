"""Spark-native analytics for sector news: DataFrame in, DataFrame out."""
