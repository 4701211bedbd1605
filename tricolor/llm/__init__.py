"""Training-data operators: deduplication, packing, search, filtering, formatting, mixing, sharding.

Nothing else in the library imports this subpackage; ``queries.py`` holds its registered
queries and their SQL twins.
"""
