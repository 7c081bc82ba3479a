"""Operators that prepare training corpora. Nothing else in presswire imports this subpackage."""
