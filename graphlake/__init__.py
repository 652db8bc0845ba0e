"""graphlake: code-graph analytics, retrieval and data-pipeline operators on Spark DataFrames."""
