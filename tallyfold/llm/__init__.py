"""Operators for text and matching by content. Nothing outside this subpackage imports it."""
