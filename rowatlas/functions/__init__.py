"""functions of the row-document engine."""
