"""Column functions. Every one is a built-in expression; none is a Python UDF."""
