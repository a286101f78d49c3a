"""skeinlake - a Spark-native engine for building, auditing and evaluating annotation datasets."""

__version__ = "0.1.0"
