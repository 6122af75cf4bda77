"""Operators for preparing language-model training data at cluster scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general DataFrame interface; ``queries`` wires the operators to
the standard tables.
"""
