"""Explore tables and keep what was learned about them, on Spark.

Every operator takes DataFrames and returns a lazy DataFrame.  Python code on the
driver only reads schemas to choose expressions.
"""
