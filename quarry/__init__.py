"""quarry: a Spark-native analytics engine for software delivery pipelines."""
