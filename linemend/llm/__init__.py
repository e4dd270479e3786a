"""Operators for training data: one module each, queries in `queries`.

Operators take a DataFrame with an integer id and a text column and select only what they
need under names of their own, so further columns, whatever their names, do not disturb them.
"""
