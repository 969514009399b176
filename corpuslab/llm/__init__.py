"""Training-data pipeline operators: token output, near-duplicates, decontamination, search, sharding, filters."""
