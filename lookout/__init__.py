"""lookout: a PySpark-native engine for brand-abuse detection data."""

__version__ = "0.1.0"
