"""Training-data pipeline operators (PII, extraction, packing, dedup, search, language, decontamination, licences, sharding, token files, hard negatives, Merkle manifest)."""
