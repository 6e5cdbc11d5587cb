"""A PySpark-native document-analytics and rule-evaluation engine."""
