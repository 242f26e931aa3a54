"""Operators for preparing language-model training data.

Ten independent modules; nothing outside this package imports it.  Every
operator takes DataFrames and returns DataFrames, reads only the columns it
names (other columns, whatever they are called, never reach it) and states in
its docstring what nulls, empty texts, repeated rows and empty tables give.
"""
