"""Operators for preparing training corpora. Nothing else in the library depends on this subpackage."""
