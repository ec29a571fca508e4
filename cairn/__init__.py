"""cairn: a Spark-native engine for agent-memory analytics."""
