"""Named queries over the given tables, with the SQL each one is checked against."""
