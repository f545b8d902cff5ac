"""kernwerk: a PySpark-native engine for knowledge packs, retrieval, facts and evaluation."""
