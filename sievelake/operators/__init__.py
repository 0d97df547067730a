"""Sketches and graph algorithms over DataFrames."""
