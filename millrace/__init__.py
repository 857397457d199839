"""millrace: a PySpark-native search and data-preparation engine for opportunity listings."""

__version__ = "0.1.0"
