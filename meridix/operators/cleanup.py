"""Deletion that spreads along references, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.sources.tables import written


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` go when their ``column`` names a value of ``key`` in a row of ``parent`` that goes; ``where`` (SQL) limits which child rows refer at all."""

    child: str
    column: str
    parent: str
    key: str
    where: str | None = None


def cascade(tables: dict[str, DataFrame], rejected: dict[str, DataFrame], references: list[Reference], keys: dict[str, str]) -> dict[str, DataFrame]:
    """Per table the keys of the rows that go, each once: those of ``rejected`` and those that refer, over any number of steps, to a row that goes.

    A level is the references whose parents lost rows in the level before; it reads the children's reference columns only,
    and its new keys are written before the next one starts, so circles end when a level finds nothing new. Null references
    refer to nothing."""
    gone = {name: written(rejected[name].select(keys[name]).distinct(), f"gone-{name}") if name in rejected else None for name in tables}
    fresh, turn = {name: rows for name, rows in gone.items() if rows is not None and not rows.isEmpty()}, 0
    while fresh:
        turn += 1
        found: dict[str, DataFrame] = {}
        for r in references:
            if r.parent in fresh:
                child = tables[r.child] if r.where is None else tables[r.child].where(r.where)
                values = tables[r.parent].join(fresh[r.parent], keys[r.parent], "left_semi").select(F.col(r.key).alias("_value")).where("_value is not null").distinct()
                hit = child.where(F.col(r.column).isNotNull()).join(values, F.col(r.column) == F.col("_value"), "left_semi").select(keys[r.child])
                found[r.child] = found[r.child].union(hit) if r.child in found else hit
        fresh = {}
        for name, rows in found.items():
            new = rows.distinct() if gone[name] is None else rows.distinct().join(gone[name], keys[name], "left_anti")
            new = written(new, f"gone-{name}-{turn}")
            if not new.isEmpty():
                fresh[name] = new
                gone[name] = new if gone[name] is None else gone[name].union(new)
    return {name: tables[name].select(keys[name]).limit(0) if rows is None else rows for name, rows in gone.items()}


def kept(tables: dict[str, DataFrame], gone: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """The rows that stay."""
    return {name: rows.join(gone[name], keys[name], "left_anti") for name, rows in tables.items()}
