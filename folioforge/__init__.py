"""A PySpark-native engine for document evidence: fusion, chunking, retrieval and grounded answers."""
