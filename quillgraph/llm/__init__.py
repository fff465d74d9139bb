"""Training-data operators: filtering, deduplication, scoring, mixing, packing and search.

Nothing else in the library imports this subpackage; it can be removed without effect on the rest.
"""
