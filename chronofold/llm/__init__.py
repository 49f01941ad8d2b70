"""Operators for text and number corpora that feed language models; nothing outside this package imports it."""
