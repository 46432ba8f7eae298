"""DataFrame operators: DataFrames in, DataFrames out; nothing is collected."""
