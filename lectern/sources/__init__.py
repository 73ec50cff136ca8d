"""Where pages and texts come from."""
