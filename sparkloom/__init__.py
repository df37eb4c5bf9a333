"""PySpark-native engine for record pipelines over versioned source code and free text."""
