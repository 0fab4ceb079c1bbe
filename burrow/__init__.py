"""burrow: a Spark-native engine for searching and analysing file namespaces."""
