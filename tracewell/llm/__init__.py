"""Training-data operators: ten numbered components on Spark DataFrames.

Nothing outside this folder imports it; the rest of the library works without it.
"""
