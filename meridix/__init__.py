"""A Spark-native engine for account, engagement and training-data analytics."""
