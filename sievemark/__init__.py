"""A Spark-native engine that validates and annotates JSON documents at scale."""
