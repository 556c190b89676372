"""Point-cloud analytics for power corridors and terrain, on Spark DataFrames."""
