"""probelake: a Spark-native engine for building and scoring code-reasoning datasets."""
