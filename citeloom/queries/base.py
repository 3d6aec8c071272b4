"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    text: str | Callable[[], str] | None
    covers: str

    @property
    def sql(self) -> str | None:
        return self.text() if callable(self.text) else self.text


REGISTRY: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | Callable[[], str] | None = None) -> Callable[[Run], Run]:
    """Register a query. ``covers`` lists the inventory rows it exercises."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Entry(lambda spark, folder: tidy(run(spark, folder)), sql, covers)
        return run

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Result types shared with the SQL side: 64-bit integers, doubles at six decimals."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- SQL fragments

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}
STORED: set[str] = set()


def fragment(name: str, body: str, *needs: str, stored: bool = False) -> None:
    """A common table expression; ``stored`` ones are computed once however often they are named."""
    FRAGMENTS[name] = (needs, body)
    if stored:
        STORED.add(name)


def sql(body: str, *needs: str) -> Callable[[], str]:
    """``body`` behind the common table expressions it needs, put together when asked for."""
    return lambda: _render(body, needs)


def _render(body: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in FRAGMENTS[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in STORED else ''}({FRAGMENTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}"
