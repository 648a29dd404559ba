"""Training-data operators: sharding, joins, fingerprints, packing, tokens, search, languages, pages, secrets, scores.

Nothing outside this subpackage imports it; `catalog` holds its queries and their SQL.
"""
