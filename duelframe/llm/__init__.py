"""Training-data operators: language ID, toxicity, near duplicates, secrets, packing, WARC,
quality rules, exact search, byte-level BPE, PII, hard negatives, a Merkle manifest and
source mixing.  Nothing outside this folder (but the guarded hook in ``__spark_entry__``
and ``corpus_pipeline``) imports it."""
