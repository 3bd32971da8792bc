"""weftgraph: dependency-graph analytics and corpus preparation on Spark DataFrames."""
