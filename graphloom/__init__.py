"""Code-graph analytics on Spark DataFrames: typed, provenance-tagged property graphs and the questions asked of them."""
