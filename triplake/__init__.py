"""Graph-mapped federation, schema-drift and corpus jobs on Spark DataFrames."""
