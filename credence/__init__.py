"""Bayesian networks as Spark DataFrames, and operators for training data."""
