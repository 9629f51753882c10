"""Spark-native analytics for curating large media and document catalogues."""
