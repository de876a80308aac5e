"""Operators for large training corpora: tokenising, scanning, sharding, mixing and deduplicating documents."""
