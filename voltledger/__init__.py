"""Retail energy overpayment analytics on Spark DataFrames."""
