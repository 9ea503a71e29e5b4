"""Computations on three-dimensional Cartesian grids, declared as Spark DataFrames."""
