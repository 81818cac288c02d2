"""streaming of the row-document engine."""
