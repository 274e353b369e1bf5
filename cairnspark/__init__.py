"""Code-graph analytics and change impact on Spark DataFrames."""
