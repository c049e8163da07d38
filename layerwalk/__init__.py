"""Multilayer diffusion graphs over short time series, as Spark DataFrames."""
