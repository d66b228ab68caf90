"""PySpark-native engine for planning and evaluating randomised street-level field surveys."""
