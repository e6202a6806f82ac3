"""Analytics on paired, irregularly observed time series, built on Spark DataFrames."""
