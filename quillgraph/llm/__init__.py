"""Operators for building text training corpora; nothing outside this subpackage imports it."""
