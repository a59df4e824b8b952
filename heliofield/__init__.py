"""Solar-shading analytics on PySpark DataFrames."""
