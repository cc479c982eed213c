"""A small decorator registry for queries and their SQL counterparts."""

from __future__ import annotations

from .corpora import finish


def registry():
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, oracle: str | None = None):
        def register(fn):
            queries[name] = lambda spark, sf: finish(fn(spark, sf))
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return register

    return queries, oracles, query
