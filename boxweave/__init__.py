"""A Spark-native engine for preparing annotated-image datasets."""
