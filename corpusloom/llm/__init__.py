"""Training-data operators: scoring, archives, decontamination, filters, sharding, dedup,
packing and extraction.  Nothing else in the library imports this subpackage."""
