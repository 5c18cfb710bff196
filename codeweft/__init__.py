"""codeweft: a code knowledge graph built, ranked and searched with PySpark DataFrames."""
