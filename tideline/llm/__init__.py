"""Training-data operators: URL filters, fingerprints, licence scans, dedup, WARC, decontamination, language ID, BPE, toxicity."""
