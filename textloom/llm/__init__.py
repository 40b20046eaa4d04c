"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; ``queries`` applies them with production parameters to the
driver tables.
"""
