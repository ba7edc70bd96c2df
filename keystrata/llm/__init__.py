"""Operators for preparing training corpora. Nothing else in keystrata imports this subpackage."""
