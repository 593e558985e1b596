"""loomgraph: causal-structure analytics on Spark DataFrames."""
