"""tidemark: a PySpark-native analytics engine for entity, filing and event data."""
