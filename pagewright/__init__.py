"""A Spark-native engine for product pages and text corpora."""
