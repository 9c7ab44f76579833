"""Grid-panel analytics and corpus preparation on Spark DataFrames."""
