"""corpuskit: a PySpark-native engine for preparing and analysing text corpora."""

__version__ = "0.1.0"
