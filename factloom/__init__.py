"""factloom: evidence graphs of code and its executions as Spark DataFrames."""
