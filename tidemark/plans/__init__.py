"""Registered queries over the shared test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from tidemark.plans import backtest, clv, distributions, evaluation, gates, market, parsing, players, products, reports, shards, snapshots, state, stats, stores, tables, timing

MODULES = (snapshots, tables, state, market, distributions, evaluation, products, reports, parsing, clv, timing, stats, gates, shards, players, stores, backtest)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
