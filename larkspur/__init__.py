"""Spark-first graph ranking: edge lists, prepared graphs, shard plans and PageRank as DataFrames."""
