"""Trajectory analytics and feature pipelines on Spark DataFrames."""
