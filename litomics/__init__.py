"""PySpark-native analytics over literature and multi-omics tables."""
