"""See README for the layout."""
