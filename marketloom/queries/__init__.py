"""Registered queries, a module per family; importing this package registers them all."""

from . import admin, backtest, composites, distributions, facts, filters, horizons, ledger, market, models, options, pair_lab, pairs, reports, search, sources, streams, technical, text  # noqa: F401
