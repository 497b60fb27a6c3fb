"""foliant: a Spark-native engine for building and querying a permissioned document corpus."""
