"""Training-data operators over documents: quality, licences, cleaning, packing, tokens, toxicity, shards, dedup, joins, secrets."""
