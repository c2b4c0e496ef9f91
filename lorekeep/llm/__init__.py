"""Training-data operators: dedup, tokenisation, scoring, mixing, archives.

Nothing else in the package imports this subpackage.
"""
