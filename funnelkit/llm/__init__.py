"""Training-data operators: ten corpus operators, each built by its own method.

Nothing else in the library imports this package.  Every operator reads columns by name and
returns its own columns, so further columns of the input, whatever their names, play no part.
"""
