"""An n-dimensional array engine on Spark DataFrames."""
