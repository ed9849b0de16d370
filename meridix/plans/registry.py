"""Registered queries: a function (spark, folder) -> DataFrame and, where there is one, its DuckDB twin."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register
