"""Queries of the text operators."""

from __future__ import annotations

from loomspan.llm import mixing, mojibake, tokens

_PARTS = (tokens, mixing, mojibake)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}
