"""Training-data operators: filtering, deduplication, scanning, sharding and tokenising of text corpora."""
