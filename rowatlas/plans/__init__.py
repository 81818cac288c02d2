"""plans of the row-document engine."""
