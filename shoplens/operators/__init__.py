"""The analytics operators: DataFrames in, DataFrames out."""
