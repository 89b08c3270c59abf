"""Analytics over tables of binary document containers, on Spark."""
