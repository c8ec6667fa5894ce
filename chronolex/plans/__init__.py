"""A database of aggregates and the queries over it."""
