"""Literature analytics on Spark: resolution, marts, boards, facets, trends and retrieval."""
