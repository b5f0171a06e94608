"""Column expressions for boxes and polygons."""
