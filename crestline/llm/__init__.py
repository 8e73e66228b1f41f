"""Training-data operators: packing, scoring, de-duplication, scans and extraction over text tables."""
