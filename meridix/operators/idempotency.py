"""Idempotent acceptance under several unique keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.sources.tables import written

#: Parts over which the rows of a frequent key value are dealt when they meet it, and the number of rows from which a value is frequent.
PARTS, FREQUENT = 16, 100_000


def _links(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """A row for each key value that isn't null: the row's place in the order, its number of keys, which key, the value."""
    values = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(name).cast("string").alias("value")) for k, name in enumerate(keys)]), lambda s: s["value"].isNotNull())
    return rows.select(F.col(order).alias("at"), values.alias("values")).select("at", F.size("values").alias("n"), F.explode("values").alias("v")).select("at", "n", "v.kind", "v.value")


def _touching(links: DataFrame, taken: DataFrame, sizes: DataFrame, frequent: int) -> DataFrame:
    """Rows of ``links`` (at) that have one of the key values ``taken`` (kind, value, each once).

    ``sizes`` (kind, value, rows) has all values of ``links``; one with ``frequent`` rows or more goes to PARTS tasks. Such values are
    at most a ``frequent``-th of the links and alone are broadcast; all else grows with the rows, whatever its files weigh, and is shuffled."""
    hot = F.broadcast(sizes.where(F.col("rows") >= frequent).select("kind", "value", F.lit(PARTS).alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = taken.join(hot, ["kind", "value"], "left").select("kind", "value", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    spread = links.join(hot, ["kind", "value"], "left").select("at", "kind", "value", F.pmod(F.xxhash64("at"), parts).cast("int").alias("part"))
    return spread.join(dealt.hint("merge"), ["kind", "value", "part"], "left_semi").select("at").distinct()


def first_accepted(rows: DataFrame, order: str, keys: list[str], frequent: int = FREQUENT) -> DataFrame:
    """The rows that stay when each is inserted in ``order`` (unique) unless a row that stayed has one of its keys; null keys never collide.

    A row that comes first under every key that it has stays, whatever the others are; the rows that share a key with it go.
    Then the next ones come first, until nothing is left: each round is two aggregates and two joins, and a row that was
    dropped no longer blocks anyone. Keys that chain rows in their order take a round a link."""
    todo = written(_links(rows, order, keys), "accept-0")
    accepted, turn = [], 0
    while not todo.isEmpty():
        first = todo.groupBy("kind", "value").agg(F.min(F.struct("at", "n")).alias("first"), F.count(F.lit(1)).alias("rows"))
        first = written(first.select("kind", "value", "first.at", "first.n", "rows"), f"accept-first-{turn}")
        wins = written(first.groupBy("at").agg(F.count(F.lit(1)).alias("won"), F.first("n").alias("n")).where("won = n").select("at"), f"accept-wins-{turn}")
        accepted.append(wins)
        gone = _touching(todo, first.join(wins.hint("merge"), "at", "left_semi"), first, frequent)
        turn += 1
        todo = written(todo.join(gone.hint("merge"), "at", "left_anti"), f"accept-{turn}")
    free = rows.where(F.forall(F.array(*[F.col(k).cast("string") for k in keys]), lambda k: k.isNull()))
    if not accepted:
        return free
    won = accepted[0]
    for more in accepted[1:]:
        won = won.union(more)
    return rows.join(won.withColumnRenamed("at", order).hint("merge"), order, "left_semi").select(*rows.columns).union(free)


def not_stored(rows: DataFrame, stored: DataFrame, order: str, keys: list[str], frequent: int = FREQUENT) -> DataFrame:
    """The rows that share no key with a stored one."""
    known, links = _links(stored, order, keys).select("kind", "value").distinct(), _links(rows, order, keys)
    gone = _touching(links, known, links.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows")), frequent)
    return rows.join(gone.withColumnRenamed("at", order).hint("merge"), order, "left_anti").select(*rows.columns)
