"""Spark-native engine for large collections of books and crawled pages."""
