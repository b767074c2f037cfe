"""tracegraph: integrity, coverage, lineage and history questions on Spark DataFrames."""
