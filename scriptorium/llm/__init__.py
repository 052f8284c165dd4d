"""Training-data operators: media, chat, deduplication, tokenising, packing, filtering and search.

Nothing outside this subpackage imports it.
"""
