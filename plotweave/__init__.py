"""plotweave: a PySpark-native engine for conflated site models and their analytics."""

__version__ = "0.1.0"
