"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registrar(queries: dict, oracles: dict) -> Callable:
    """A decorator that files a query under its name, and its SQL if there is one; `also` is a second name that it is known by."""

    def query(sql: str | None = None, also: str | None = None) -> Callable:
        def file(f: Callable) -> Callable:
            for name in filter(None, (f.__name__, also)):
                queries[name] = f
                if sql:
                    oracles[name] = sql
            return f

        return file

    return query


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals and timestamps as text, so that engines can be compared by value."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def num(*names: str) -> str:
    """SQL of the same rounding."""
    return ", ".join(f"round({n}::double, 6) + 0.0::double as {n.split('.')[-1]}" for n in names)


def ts(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') as {name.split('.')[-1]}"
