"""Property-graph analytics and data preparation on PySpark DataFrames."""
