"""Operators for preparing training data, each one a DataFrame -> DataFrame function."""
