"""Data contracts for DataFrames: schema documents compiled to column expressions."""
