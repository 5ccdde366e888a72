"""Operators for building training corpora; a subpackage that nothing else in the library imports."""
