"""Text hygiene and corpus analytics on Spark DataFrames."""
