"""metricloom: a PySpark-native engine for metrics aggregation and corpus preparation."""
