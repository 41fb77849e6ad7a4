"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat_template, fingerprints, jaccard_join, language, licences, mixing, mpeg, quality, url_filter

MODULES = [fingerprints, quality, mixing, language, bpe, chat_template, url_filter, mpeg, jaccard_join, licences]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
