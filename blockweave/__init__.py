"""A Spark-native engine for entity blocking and trajectory analytics."""
