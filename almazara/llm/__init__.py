"""Operators on text corpora: token ids, packing into containers, reading level."""
