"""Training-data operators: ten corpus operators, one module each (op1 .. op10), and their queries.

Nothing else in the library imports this subpackage.
"""
