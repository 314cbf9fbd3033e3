"""Operators: DataFrame to DataFrame, composable with ``DataFrame.transform``."""
