"""A PySpark-native engine for text analytics: counting, sketches, signatures, classifiers."""
