"""A PySpark-native engine for comparing corpora: similarity, matching, dependency and parity analytics."""
