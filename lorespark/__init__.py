"""lorespark: a Spark-native analytics engine for scholarly profiles."""
