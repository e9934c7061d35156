"""PySpark-native analytics over agent transcripts: leak matching, rates, tests and verdicts."""

__version__ = "0.1.0"
