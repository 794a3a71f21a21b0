"""Which files of a lake hold a value, and how its metadata is distributed: indexes and queries on Spark."""
