"""A table of queries and their SQL, filled by decoration."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    queries: dict = {}
    sql: dict = {}

    def query(name: str, oracle: str | None = None):
        def add(run):
            if name in queries:
                raise ValueError(f"{name} is registered twice")
            queries[name] = run
            if oracle is not None:
                sql[name] = oracle
            return run

        return add

    return queries, sql, query
