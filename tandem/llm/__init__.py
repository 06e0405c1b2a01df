"""Training-data operators: ten text operators, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
