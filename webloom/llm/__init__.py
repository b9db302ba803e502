"""Operators that prepare text for language-model training.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
