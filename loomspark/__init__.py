"""loomspark: a PySpark-native engine of table, key, JSON and log jobs."""
