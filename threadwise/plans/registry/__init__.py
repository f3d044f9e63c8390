"""Queries on the sample tables, one per inventory item, with their SQL where SQL can say it."""

from __future__ import annotations

from threadwise.plans.registry import chain, classify, live, records, routes, samples, search, texts, threads

MODULES = (threads, texts, samples, classify, search, routes, records, live, chain)

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
