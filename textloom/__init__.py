"""Text analytics on Spark DataFrames: cleaning, keyword matching, group policies, summaries and model outputs."""
