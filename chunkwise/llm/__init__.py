"""Operators for training-data pipelines (packing, dedup, quality, language, tokens).

One module per operator; ``queries`` registers them.  Nothing else in the
library imports this subpackage.
"""
