"""sources of the row-document engine."""
