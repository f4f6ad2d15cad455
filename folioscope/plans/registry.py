"""The registered queries and the DuckDB SQL that says the same."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, function, oracle: str | None = None) -> None:
    QUERIES[name] = function
    if oracle:
        ORACLES[name] = oracle


def query(oracle: str | None = None):
    """Registers a function under its own name."""

    def add(f):
        register(f.__name__, f, oracle)
        return f

    return add
