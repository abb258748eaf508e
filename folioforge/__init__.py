"""Document intelligence on Spark DataFrames: parsing, chunking, retrieval, semantic graphs, jobs."""
