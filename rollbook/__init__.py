"""rollbook: a Spark-native engine for directory records and usage analytics."""
