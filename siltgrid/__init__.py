"""siltgrid: gridded, vector and time-series event analysis on Spark DataFrames."""
