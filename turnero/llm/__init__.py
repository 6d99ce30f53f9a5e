"""Operators for preparing language-model training data.

Each module holds one operator: functions from DataFrames to DataFrames that take column names as
parameters, read only the columns they name and ignore any other column.  ``consultas`` registers
the queries.  Nothing else in the library imports this package.
"""
