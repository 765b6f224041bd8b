"""Tessera: spatial tissue analytics and corpus preparation on Spark DataFrames."""
