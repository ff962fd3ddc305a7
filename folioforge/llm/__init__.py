"""Operators for preparing large text corpora; nothing else in the library imports this subpackage.

Each operator lives in a module of its own and works on any DataFrame with the
columns it names.  `registry` binds them to the driver's tables.
"""
