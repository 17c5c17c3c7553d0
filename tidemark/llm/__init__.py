"""Training-data operators: packing, deduplication, rules, mixing, fingerprints and classifiers.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
