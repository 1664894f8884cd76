"""Column -> Column functions: row-local, so they also run on streaming DataFrames."""
