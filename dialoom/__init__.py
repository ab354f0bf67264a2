"""dialoom: Spark-native operators for turn-structured corpora."""
