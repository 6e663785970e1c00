"""quillmatch: a PySpark-native engine for data correction and entity resolution."""

__version__ = "0.1.0"
