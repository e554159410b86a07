"""Analytics over neuronal wiring data as Spark DataFrames."""
