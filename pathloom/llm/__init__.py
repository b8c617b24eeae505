"""Operators on language-model text and vectors. Nothing outside this subpackage imports it."""
