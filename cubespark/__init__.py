"""Analytics on labelled data cubes kept as tidy Spark DataFrames."""
