"""Steps that depend on what was chosen before: one pass of Python over sorted rows, or over each small, keyed group."""

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Parts that rows of one key and size are dealt to before they meet.
SALTS = 32


def accept_after_gap(df: DataFrame, keys: Sequence[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Adds ``accepted``: true over ``seconds`` after the last accepted row of the key.

    Rows arrive sorted by key and time, and the state is the last accepted time, so a key of any size is one pass over
    batches, and many small keys share one. Rows without a time come last: null, or true for the first of a key that has no other.
    """
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = (), None
        for batch in batches:
            times = batch.column(len(names)).to_pylist()
            found = []
            for key, at in zip(zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True), times, strict=True):
                takes = key != of or (at - last > seconds * 1_000_000 if at is not None else None)
                if takes:
                    of, last = key, at
                found.append(takes)
            columns = [*batch.columns[: len(names)], pa.array(found, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "accepted"])

    rows = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, F.col("_at").asc_nulls_last(), tie)
    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("accepted", BooleanType())]))


def take_while_fits(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows in order that still fit the key's budget; one that does not is skipped, later ones may fit. The first is always taken.

    Sizes are whole numbers over 0, and ``order`` is total. Once a size does not fit, it never fits again, so of each
    size only its first ``budget // size`` rows can be taken, and of all sizes over the budget only the key's first row.
    Only these (about ``budget * ln(budget)`` rows a key at most) meet in one group; windows find them, salted first.
    """
    same = F.least(F.col(size).cast("bigint"), F.lit(budget + 1))
    most = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_size")))
    rows = df.withColumn("_size", same).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for part in ([*keys, "_size", "_salt"], [*keys, "_size"]):
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_place") <= most)
    reach = rows.select(*df.columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable")
        left, keep = budget, []
        for i, n in enumerate(group[size].tolist()):
            fits = n <= left or i == 0
            keep.append(fits)
            left -= n if fits else 0
        return group[keep]

    return reach.groupBy(*keys).applyInPandas(run, df.schema)
