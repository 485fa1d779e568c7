"""A PySpark-native engine for lexicon, retrieval and audit analytics."""
