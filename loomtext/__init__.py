"""Text pattern analytics for Spark: exact and approximate matching over DataFrames."""
