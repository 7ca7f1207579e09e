"""loomgraph: graphs, events and documents as ordinary Spark DataFrames."""
