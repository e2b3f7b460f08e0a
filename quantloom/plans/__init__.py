"""Strategy graphs and their translation to columns."""
