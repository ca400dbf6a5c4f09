"""symloom: a PySpark-native code-intelligence and corpus-preparation engine."""
