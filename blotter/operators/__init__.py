"""Operators: each is a ``DataFrame -> DataFrame`` function, fit for ``df.transform``."""
