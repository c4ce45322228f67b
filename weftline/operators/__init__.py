"""Operators: each takes and returns DataFrames. Inventory ids are in the docstrings."""
