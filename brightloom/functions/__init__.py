"""Scalar functions: dictionaries, codecs, formatting."""
