"""tracewell: signal-feature analytics as Spark DataFrame operations."""
