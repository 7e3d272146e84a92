"""Per-user notification feeds, and the operation logs around them, as Spark jobs."""
