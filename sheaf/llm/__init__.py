"""Operators for training data made of texts; nothing else in the package imports them."""
