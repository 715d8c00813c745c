"""Path queries over labelled flow graphs, built on Spark DataFrames."""
