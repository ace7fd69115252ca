"""Approximate nearest neighbours: an HNSW graph per shard in flat arrays, shard results merged."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import hnsw
from tessera.llm.common import cut

#: Distinct vectors of a shard, and queries of a block, on average.
SHARD, QUERIES = 8192, 1024
_INDEX = "dim int, shard int, n bigint, ids binary, offsets binary, vectors binary, level binary, depth int, graph binary"


def valid(vectors: DataFrame) -> DataFrame:
    """Rows that take part: ``vec_id`` and ``v``, not null, not zero, every component finite."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    )
    return rows.distinct()


def _packed(table: pa.Table, dtype) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(table.num_rows, -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two that brings their largest component near 1: cosines stay the same, and squares stay doubles."""
    wide = x.astype(np.float64)
    _, power = np.frexp(np.abs(wide).max(axis=1, keepdims=True))
    return np.ldexp(wide, -power)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = _scaled(x)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def index(rows: DataFrame, copies: int) -> DataFrame:
    """One row per shard: ids, vectors and graph of its distinct vectors, as flat arrays.

    Equal vectors are one point of the graph that lists its ``copies`` smallest vec_id, all that any
    result can hold, so a vector that a third of all rows share is neither a hot shard nor a clique.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    some = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= copies)
    points = cut(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-points.count() // SHARD))
    dtype = np.float32 if "float" in dict(rows.dtypes)["v"] else np.float64

    def build(table: pa.Table) -> pa.Table:
        x = _packed(table, dtype)
        level, graph = hnsw.build(_unit(x))
        ids = table.column("ids").combine_chunks()
        return pa.Table.from_pylist(
            [
                {
                    "dim": table.column("dim")[0].as_py(),
                    "shard": table.column("shard")[0].as_py(),
                    "n": len(x),
                    "ids": ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    "offsets": np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64).tobytes(),
                    "vectors": x.tobytes(),
                    "level": level.tobytes(),
                    "depth": len(graph),
                    "graph": b"".join(g.tobytes() for g in graph),
                }
            ],
            schema=_schema(_INDEX),
        )

    placed = points.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return cut(placed.groupBy("dim", "shard").applyInArrow(build, _INDEX))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _graph(row: dict) -> list[np.ndarray]:
    flat, graph, at = np.frombuffer(row["graph"], np.int32), [], 0
    for h in range(row["depth"]):
        wide = 2 * hnsw.M if h == 0 else hnsw.M
        graph.append(flat[at : at + row["n"] * wide].reshape(row["n"], wide))
        at += row["n"] * wide
    return graph


def neighbours(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The ``k`` nearest by cosine of each row whose vec_id is divisible by ``every``, against all rows.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller vec_id; the score is
    the cosine of the original vectors in double precision. Every shard's graph is walked for each
    block of queries, and a query's shard results are merged by a ranked window that keeps ``k`` rows.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without vec_id. Vectors of different lengths are never compared. Repeated rows are one candidate; a
    query never finds its own vec_id. Components of any size in the double range count. Fewer candidates than ``k``: all of them. Empty table: no rows.
    Other columns are ignored.
    """
    rows = valid(vectors)
    shards = index(rows, k + 1)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("dim", F.size("v"))
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    # One row per block of about QUERIES queries, sent once to each shard of its vectors' length.
    packed = asked.groupBy("dim", block).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    numbers = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    sent = packed.join(numbers, "dim").withColumn("shard", F.explode("shards")).select("dim", "shard", "queries")
    dtype = np.float32 if "float" in dict(rows.dtypes)["v"] else np.float64

    def walk(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dim", "n", "ids", "offsets", "vectors", "level", "depth", "graph")}
                queries = batch.column("queries")[i].values
                own = queries.field("vec_id").to_numpy()
                q = queries.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                x = np.frombuffer(row["vectors"], dtype).reshape(row["n"], row["dim"])
                ids, offsets = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64)
                level = np.frombuffer(row["level"], np.int8)
                near = hnsw.search(_unit(x), level, _graph(row), _unit(q))[:, : 2 * k + 8]
                of, spot = np.nonzero(near >= 0)
                point = near[of, spot]
                a, b = _scaled(q)[of], _scaled(x[point])
                score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                many = offsets[point + 1] - offsets[point]
                of, score = np.repeat(of, many), np.repeat(score, many)
                vec = ids[np.repeat(offsets[point], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                keep = vec != own[of]
                of, score, vec = of[keep], score[keep], vec[keep]
                order = np.lexsort((vec, -score, of))
                of, score, vec = of[order], score[order], vec[order]
                rank = np.arange(len(of)) - np.searchsorted(of, of)
                best = rank < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[of[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"]
                )

    pairs = shards.join(sent, ["dim", "shard"]).drop("shard")
    found = pairs.mapInArrow(walk, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
