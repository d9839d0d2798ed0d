"""Training-data operators: one module for each, queries and oracle SQL in ``queries``.

Nothing else in the library imports this subpackage.
"""
