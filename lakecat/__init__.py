"""lakecat: a Spark-native analytics engine for object-store catalogs."""
