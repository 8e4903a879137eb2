"""Count tables kept up to date from a stream of rows."""
