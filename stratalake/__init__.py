"""A Spark-native engine for querying and maintaining versioned columnar tables."""
