"""lectern: a PySpark-native engine for text corpora."""
