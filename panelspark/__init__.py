"""panelspark: build unit-by-wave analysis panels on Spark.

Survey microdata, raster cells, event feeds and yearly covariates go in; one row
per administrative unit and survey wave comes out.  Every operator maps
DataFrames to DataFrames, so operators chain with ``df.transform``.
"""

__version__ = "0.1.0"
