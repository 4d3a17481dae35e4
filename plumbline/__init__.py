"""plumbline: a PySpark-native engine for rule-based data quality and spatial analytics."""

__version__ = "0.1.0"
