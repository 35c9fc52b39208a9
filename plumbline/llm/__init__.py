"""Training-data operators: sharding, mixing, deduplication, packing, quality and language models.

Nothing else in the package imports this subpackage; ``queries`` registers one query per operator.
"""
