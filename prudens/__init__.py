"""Supervisory-risk analytics over bank x period x metric panels, on Spark DataFrames."""
