"""Query registry: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marketlab.sources.driver_tables import VIEWS, Lake

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    uses: str

    @property
    def sql(self) -> str | None:
        return None if self.body is None else with_ctes(self.body, self.uses)


REGISTRY: dict[str, Query] = {}
CTES: dict[str, str] = dict(VIEWS)
_LAKES: dict[tuple[str, str], Lake] = {}


def lake_for(spark: SparkSession, path: str) -> Lake:
    key = (spark.sparkContext.applicationId, path)
    if key not in _LAKES:
        _LAKES[key] = Lake(spark, path)
    return _LAKES[key]


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: doubles rounded, timestamps without zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_ctes(sql: str, names: str) -> str:
    """Prefix the named views and everything they use."""
    need: list[str] = []

    def visit(n: str) -> None:
        if n in need:
            return
        body = CTES[n]
        for other in CTES:
            if other != n and _mentions(body, other):
                visit(other)
        need.append(n)

    for n in names.split():
        visit(n)
    if not need:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in need) + "\n" + sql


def _mentions(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body) is not None


def query(name: str, sql: str | None = None, uses: str = "", floats: str = ""):
    """Register ``fn(lake) -> DataFrame`` under ``name``.

    ``floats`` lists the double columns of the oracle so both sides round alike.
    """

    def wrap(fn: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return finish(fn(lake_for(spark, path)))

        body = sql.strip() if sql is not None else None
        if body is not None and floats:
            swaps = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in floats.split())
            body = f"SELECT * REPLACE ({swaps}) FROM (\n{body}\n) AS q_"
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, body, uses)
        return fn

    return wrap


def memo(lake: Lake, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A shared intermediate table: built once per lake, kept on reliable storage."""
    from marketlab.session import materialise

    cache = lake.__dict__.setdefault("_memo", {})
    if key not in cache:
        cache[key] = materialise(build())
    return cache[key]
