"""Record analytics on PySpark: a small query builder, sketches and a graph over DataFrames."""
