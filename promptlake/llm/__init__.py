"""Training-data operators: ten numbered operators, their queries and SQL.

Nothing outside this subpackage imports it.
"""
