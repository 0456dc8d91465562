"""Training-data operators: ten large-scale text operators and their registered queries.

Nothing else in :mod:`infoloom` imports this subpackage.
"""
