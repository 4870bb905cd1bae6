"""lodestone: a Spark-native document search and text analytics engine."""
