"""operators of the row-document engine."""
