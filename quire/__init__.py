"""quire: a PySpark-native engine for document libraries (catalog, text, vector and hybrid search)."""

__version__ = "0.1.0"
