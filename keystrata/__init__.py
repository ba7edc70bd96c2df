"""Keystrata: keyed tables, ordered key/value data and transactions on PySpark DataFrames."""
