"""Relational, recursive and mark-propagating operators: DataFrame in, DataFrame out."""
