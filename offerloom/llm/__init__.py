"""Operators for preparing training text, one module each.

Nothing outside this package imports it; it imports nothing from the rest of
the library either.  :mod:`offerloom.llm.queries` lists its registered queries.
"""
