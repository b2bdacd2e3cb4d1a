"""siltstream: Spark-native analytics over labelled flow records."""
