"""millrace: a PySpark-native warehouse and corpus engine."""
