"""Short-horizon volatility analytics over order-book and trade data, on Spark.

Every operator takes and returns Spark DataFrames (or builds a ``Column``); planning,
partitioning and spilling are left to Spark.
"""
