"""Analytics over many populations, on Spark."""
