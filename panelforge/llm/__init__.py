"""Operators that prepare training corpora; nothing outside this subpackage imports it."""
