"""Raster algebra and data preparation on Spark DataFrames."""
