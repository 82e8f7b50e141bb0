"""Analytics of chronic and acute neural time series on Spark."""
