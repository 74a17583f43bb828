"""A knowledge-analytics engine on Spark DataFrames."""
