"""A Spark-native engine for preference data and ranked answers."""
