"""Point, raster and neighbourhood operators over DataFrames."""
