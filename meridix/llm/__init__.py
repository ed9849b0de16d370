"""Training-data operators: one module per operator, thin queries in ``queries.py``.

Nothing else in the library imports this subpackage.
"""
