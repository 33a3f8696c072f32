"""Holdfast: content-catalogue analytics on Spark DataFrames."""
