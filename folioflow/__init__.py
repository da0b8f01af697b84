"""folioflow: document preparation and privacy review on Spark DataFrames."""
