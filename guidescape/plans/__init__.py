"""Named queries over the benchmark tables: views, Spark plans and their SQL counterparts."""
