"""millrace: Spark-native analytics over raw messages, pages and text."""

__version__ = "0.1.0"
