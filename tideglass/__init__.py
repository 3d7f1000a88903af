"""tideglass: Spark-native analytics for posting feeds, ledgers and text corpora."""
