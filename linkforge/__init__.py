"""linkforge: a PySpark-native record-linkage and corpus-preparation engine."""
