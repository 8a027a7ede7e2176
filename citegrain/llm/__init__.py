"""Operators of a training-data pipeline: rules, dedup, mixing, tokens, secrets, urls, sampling.

Nothing else in the library imports this subpackage.
"""
