"""flowtable: work items, files and run records as Spark DataFrames."""
