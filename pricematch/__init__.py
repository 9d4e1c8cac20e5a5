"""Cross-vendor price comparison on Spark DataFrames."""
