"""skein: a Spark-native engine that turns web corpora into small cited contexts."""

__version__ = "0.1.0"
