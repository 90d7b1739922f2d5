"""Operators for preparing training data: packing, search, sharding, filters, dedup, archives, chat, tokens.

Nothing outside this package imports it. Its queries and their SQL are in ``queries``.
"""
