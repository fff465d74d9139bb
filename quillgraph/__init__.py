"""Query graphs over many small sources, lowered to Spark DataFrames."""
