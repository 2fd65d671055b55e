"""tarn: a Spark-native analytics engine for agent-memory data."""
