"""Analytics over replicated command logs, on Spark."""
