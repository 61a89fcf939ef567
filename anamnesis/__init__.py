"""A Spark-native engine for long-term conversational memory."""
