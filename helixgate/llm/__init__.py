"""Training-data operators: URL filters, near-dedup, secret scans, LM scoring, token
shards, quality rules, source mixing, decontamination, pseudonyms and line dedup.

Nothing else in the library imports this subpackage.
"""
