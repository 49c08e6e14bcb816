"""Operators that prepare training data at scale; nothing outside this subpackage imports it."""
