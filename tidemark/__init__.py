"""tidemark: Spark-native analytics over behavioural sequences."""
