"""Point-in-time analytics on append-only observation logs, written as Spark jobs."""
