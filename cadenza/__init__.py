"""Analytics of multichannel, multi-subject time series as Spark DataFrame transformations."""
