"""Log analytics and columnar log archives on Spark DataFrames."""
