"""Training-data operators: thirteen large-scale corpus operators and their driver queries.

Nothing else in the library imports this subpackage.
"""
