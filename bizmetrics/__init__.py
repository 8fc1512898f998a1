"""Business-metrics operators over sales, receivables, stock and tax tables.

Every operator takes a DataFrame and returns a DataFrame.
"""
