"""Crysmill: a Spark-native engine for screening crystal-materials records."""
