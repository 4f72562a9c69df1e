"""Training-data operators: quality cascade, mixing, secrets, language ID, token counts,
substring dedup, packing, licences, near-dedup and media.  Nothing else in the library imports this."""
