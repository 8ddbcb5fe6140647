"""Training-data operators: filters, dedup, language ID, mixing and packing.

Nothing outside this subpackage imports it.
"""
