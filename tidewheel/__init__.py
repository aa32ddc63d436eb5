"""A PySpark-native analytics engine: relational feature building, similarity, sampling, evaluation, streaming and data preparation."""
