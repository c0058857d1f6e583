"""Operators as functions of Columns and DataFrames."""
