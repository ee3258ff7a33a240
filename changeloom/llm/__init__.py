"""Operators on text for training corpora. Nothing outside this subpackage imports it."""
