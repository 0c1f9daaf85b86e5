"""lodestone: a PySpark-native analytics engine for corpora of source code and text."""
