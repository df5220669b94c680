"""Register a query together with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from watchtide.session import use_utc
from watchtide.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AREAS: dict[str, str] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output types: text timestamps, 64-bit integers, rounded doubles, joined arrays."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            col = col.cast("string")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            # adding 0.0 turns a negative zero into zero
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        elif isinstance(kind, (T.MapType, T.StructType)):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Decorator: the function gets the fixture tables and returns a DataFrame."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(views.Tables(use_utc(spark), sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        AREAS[name] = fn.__module__
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Put the fixture views a statement uses in front of it."""
    texts = views.view_sql("duckdb")
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in texts and name not in needed:
                visit(texts[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS (\n{texts[n]}\n)" for n in needed)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"
