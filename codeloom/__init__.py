"""Code-graph analytics on Spark: graphs of symbols, flows, impact, search, changes and their upkeep."""
