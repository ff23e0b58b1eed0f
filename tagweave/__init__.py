"""Codebooks, bags of tags and Poisson count factorization on Spark DataFrames."""
