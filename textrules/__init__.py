"""Sentence-rule analytics on Spark DataFrames."""
