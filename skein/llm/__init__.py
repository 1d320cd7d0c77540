"""Operators that prepare text corpora for language models. Nothing outside this package imports it."""
