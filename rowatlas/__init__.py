"""rowatlas: a PySpark-native engine for large row documents.

Everything is a lazy DataFrame keyed by a contiguous zero-based source row.
"""

__version__ = "0.1.0"
