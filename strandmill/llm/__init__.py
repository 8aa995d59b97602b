"""Operators for text and matching; nothing else in the library imports this subpackage."""
