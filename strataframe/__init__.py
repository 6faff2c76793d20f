"""strataframe: analysis of rasters, vectors and point clouds as Spark DataFrames."""

__version__ = "0.1.0"
