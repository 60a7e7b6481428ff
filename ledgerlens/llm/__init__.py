"""Training-data operators: tokens, quality, toxicity, near copies, leaks, shards, media, URLs.

Nothing outside this package imports it. ``registry`` lists its queries.
"""
