"""Terrain and raster analytics on PySpark."""
