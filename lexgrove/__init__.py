"""lexgrove: symbol-index style analytics and text search on Spark DataFrames."""
