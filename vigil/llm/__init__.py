"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Shared conventions: input tables
are never changed, only the named columns are read, output columns are
exactly those documented, and a null text counts as empty unless a function
says otherwise.
"""
