"""Named queries and their SQL, one module per family."""
