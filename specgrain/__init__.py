"""Package-metadata analytics on Spark: repository relations, dependency closure, recipe rules and cross-profile reports as DataFrames."""
