"""Operators: DataFrame in, DataFrame out. Keys and order are arguments; nothing loops over subjects."""
