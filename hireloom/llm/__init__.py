"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; it can be removed as a
whole and the rest keeps working.
"""
