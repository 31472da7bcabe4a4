"""Operators that prepare text for model training: one module each; nothing else in the library imports them."""
