"""Training-data operators: archives, packing, license scans, deduplication, quality, language and URL rules."""
