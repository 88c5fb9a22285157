"""Operators for preparing training text at scale; nothing else in tallyloom imports this subpackage."""
