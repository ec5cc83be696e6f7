"""Training-data operators: secrets, mixing, packing, PII, near duplicates, extraction, sharding,
toxicity and exact search. Nothing outside this package imports it."""
