"""Operators for preparing training text at scale; nothing else in quire imports this subpackage."""
