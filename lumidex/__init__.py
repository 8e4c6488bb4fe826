"""Lumidex: a Spark-native catalog, search and export engine for picture collections."""
