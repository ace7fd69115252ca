"""Relational building blocks: DataFrame in, DataFrame out."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (which has to be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def contains_any(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive containment in any of the columns; null columns do not match."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in columns])


#: Parts that the rows of one key are dealt to, see ``join_hot``.
PARTS = 64


def join_hot(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` (one row a ``key``), where one key may hold a third of all rows.

    A key's rows are dealt to ``PARTS`` parts by a hash of ``by``; facts go to the parts that exist, and from there to the rows.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    parts = dealt.select(key, "_part").distinct().join(facts, key)
    return dealt.join(parts, [key, "_part"], how).drop("_part")


def valid_at(start: str, end: str, at: Column) -> Column:
    """Inside a validity interval whose end may be open."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at))


def overlaps(low: str, high: str, least: Column, most: Column) -> Column:
    """Null-tolerant overlap of ``low..high`` with ``least..most``."""
    return F.coalesce(F.col(low) <= most, F.lit(True)) & F.coalesce(F.col(high) >= least, F.lit(True))


def page(df: DataFrame, number: int, size: int, *order: Column, ceiling: int | None = None) -> DataFrame:
    """One page of a totally ordered frame; numbers out of range clamp to the nearest page.

    Only the rows up to the page's end are sorted and kept (a bounded top-k), never the whole frame in one task.
    """
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(number, 1), last if ceiling is None else min(last, ceiling))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` over ``old`` by key: one shuffle of the keys that changed, no window over the rest."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def guarded_delete(rows: DataFrame, snapshot: DataFrame, protected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that the snapshot still has, or that are protected."""
    keep = snapshot.select(*keys).unionByName(protected.select(*keys)).distinct()
    return rows.join(keep, list(keys), "left_semi")


def faceted(df: DataFrame, facets: dict[str, object], search: Sequence[str] = (), q: str = "") -> DataFrame:
    """Generic list filter: equality facets, and a search over columns."""
    for column, value in facets.items():
        if value not in (None, "", []):
            df = df.filter(F.col(column).isin(*value) if isinstance(value, list | tuple) else F.col(column) == F.lit(value))
    return df.filter(contains_any(search, q)) if q else df
