"""tessera: a Spark-native engine for code facts, call logs and text corpora."""
