"""A PySpark-native engine for next-word expectations, alternatives and human judgements."""
