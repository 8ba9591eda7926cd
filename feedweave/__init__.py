"""feedweave: a Spark-native engine that turns captured web responses into feed tables."""

__version__ = "0.1.0"
