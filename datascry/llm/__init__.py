"""Operators of a training-data pipeline: token files, language models, deduplication, filters, private data, tokenizers."""
