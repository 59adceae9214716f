"""Operators for preparing training data: one module for each operator.

Nothing outside this package imports it. Every operator is a function from
DataFrames to a DataFrame; ``catalog`` holds the thin registered queries.
"""
