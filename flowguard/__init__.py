"""Packet screening and traffic anomaly analytics on Spark DataFrames."""
