"""Operators: DataFrame(s) in, DataFrame out, without an action inside."""
