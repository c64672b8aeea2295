"""Algebraic, mergeable analytics on Spark DataFrames."""
