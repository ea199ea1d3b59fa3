"""Seismic fault imaging and corpus preparation on Spark DataFrames."""
