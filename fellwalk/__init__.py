"""fellwalk: trajectory, terrain and job analytics on Spark DataFrames."""
