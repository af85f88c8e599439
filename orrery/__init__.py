"""A Spark-native engine for text correction, project indexing, graph and retrieval queries."""
