"""Scalar functions as Column expressions; Arrow UDFs only where Spark has no such function."""
