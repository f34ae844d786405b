"""Files that tables are loaded from."""
