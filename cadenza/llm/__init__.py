"""Operators for large text corpora: language ID, deduplication, decontamination, mixing, scans, WARC, chat, sharding."""
