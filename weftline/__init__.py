"""Weftline: token-sequence preparation, alignment and scoring on Spark DataFrames."""
