"""Named queries (Spark) and their SQL counterparts."""
