"""Training-data operators: dedup, fingerprints, tokenisation, packing, language and quality.

Nothing outside this subpackage imports it.
"""
