"""Operators for preparing training text: each stands alone, nothing else in the package imports them."""
