"""Kindred: duplicate detection, similarity search and library organisation on Spark DataFrames."""
