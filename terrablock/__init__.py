"""A PySpark-native engine for design-based evaluation of spatial hold-out experiments."""
