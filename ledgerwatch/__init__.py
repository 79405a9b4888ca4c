"""Transaction-fraud analytics on Spark."""
