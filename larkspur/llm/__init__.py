"""Operators for preparing training text; nothing else in larkspur imports this package."""
