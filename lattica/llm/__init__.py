"""Operators for preparing large text corpora (url filters, packing, sharding, dedup and the like).

Nothing outside this subpackage imports it.
"""
