"""Listing analytics and text-table operators on Spark DataFrames."""
