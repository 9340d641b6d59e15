"""Training-data operators: language ID, URL filters, sharding, dedup, decontamination, search, packing, archives."""
