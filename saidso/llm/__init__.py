"""Operators for corpora that train language models, and the queries that apply them to whole tables."""
