"""Linear-system datasets and solver analytics as Spark DataFrames."""
