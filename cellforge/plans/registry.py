"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

#: The y of a triangle's second corner, as written in the SQL of this package; a reserved word unless quoted.
COLUMN_BY = re.compile(r'(?<![\w"])by(?![\w"])')

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None, zeros: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame; `sql` gives the same rows in DuckDB, or is None where SQL cannot.

    `zeros` names columns of the SQL in which a negative zero is to be a plain one, as Spark's side has it.
    """
    if zeros:
        sql = f"SELECT * REPLACE ({', '.join(f'{c} + 0 AS {c}' for c in zeros)}) FROM ({sql})"

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = COLUMN_BY.sub('"by"', sql)
        return f

    return put
