"""A PySpark-native website-audit and corpus-processing engine."""
