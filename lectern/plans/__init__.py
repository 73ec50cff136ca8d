"""Named queries over the tables, and the storage they share."""
