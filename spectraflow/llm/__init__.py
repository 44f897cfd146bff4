"""Training-data operators: mixing, token counts, packing, quality rules, token
codes, media columns, near-duplicates, toxicity, HTML extraction and sharding.

Nothing else in the library imports this subpackage.
"""
