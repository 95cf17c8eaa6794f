"""Analytics over program relations and training text, declared as Spark DataFrames."""
