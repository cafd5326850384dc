"""A PySpark-native engine for event detection, labelling and evaluation."""
