"""Centroid clustering over a vector-approximation file: few-bit cells, lookup tables of distance intervals."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Components of a vector, centroids, and rounds of moving them. Fixed by the contract.
DIM, CENTROIDS, ROUNDS = 64, 40, 5
#: Bits of a cell, and vectors of a block at most.
BITS, BLOCK = 6, 4096
#: Integer components stay below this, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
_CELLS = 1 << BITS
_BLOCK_DDL = "ids binary, named binary, cells binary, vectors binary"


def grid(component: Column) -> Column:
    """The integer that stands for a component."""
    return F.floor(component.cast("double") * 256)


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part: ``DIM`` components, none null or non-finite, none of 2^19 or more."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= float(LARGEST // 256))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.filter(F.coalesce(F.size("v") == DIM, F.lit(False)) & ~F.exists("v", bad))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of smallest hash of their vec_id, in that order; equal ids in order of their components."""
    sha = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    ints = F.transform("v", grid)
    found = rows.filter("vec_id IS NOT NULL").select(sha.alias("sha"), ints.alias("x")).orderBy("sha", "x").limit(k).collect()
    return np.array([r.x for r in found], np.int64).reshape(-1, DIM)


def edges(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner cell borders of each dimension by approximate quantiles of all vectors, and least and largest components.

    Any borders give the same clusters; these make cells about equally full.
    """
    at = [(i + 1) / _CELLS for i in range(_CELLS - 1)]
    parts = rows.select(F.posexplode(F.transform("v", grid)).alias("j", "x")).groupBy("j")
    found = sorted(parts.agg(F.percentile_approx("x", at, 1000).alias("at"), F.min("x").alias("least"), F.max("x").alias("most")).collect())  # a row a dimension
    return np.array([r["at"] for r in found], np.int64), np.array([r.least for r in found], np.int64), np.array([r.most for r in found], np.int64)


def approximated(rows: DataFrame, borders: np.ndarray) -> DataFrame:
    """The file: a row for each block of at most ``BLOCK`` vectors, their ids, packed cells, and full vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, flat = part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False)
                x = np.floor(flat.astype(np.float64).reshape(-1, DIM) * 256).astype(np.int32)
                cells = np.stack([np.searchsorted(borders[j], x[:, j], side="right") for j in range(DIM)], 1).astype(np.uint8)
                bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - BITS :]
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                raw = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), named.tobytes(), np.packbits(bits).tobytes(), x.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in raw], names=["ids", "named", "cells", "vectors"])

    return rows.mapInArrow(pack, _BLOCK_DDL)


def unpacked(cells: bytes) -> np.ndarray:
    """Cell numbers, a row for each vector."""
    bits = np.unpackbits(np.frombuffer(cells, np.uint8)).reshape(-1, DIM, BITS)
    return np.packbits(np.concatenate([np.zeros((*bits.shape[:2], 8 - BITS), np.uint8), bits], axis=2), axis=2)[:, :, 0]


def lookup(centroids: np.ndarray, borders: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each dimension and cell, the least squared difference of its integers to each centroid, then the largest."""
    low = np.concatenate([least[:, None], borders], axis=1)[:, :, None] - centroids.T[:, None, :]
    high = np.concatenate([borders - 1, most[:, None]], axis=1)[:, :, None] - centroids.T[:, None, :]
    near = np.maximum(np.maximum(low, -high), 0)
    tables = np.concatenate([near * near, np.maximum(low * low, high * high)], axis=2)
    # The narrower type where no sum leaves it: sums are the same.
    return tables.astype(np.int32) if int(tables.max(axis=(1, 2)).sum()) < 1 << 31 else tables


def nearest(cells: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, int]:
    """Each vector's nearest centroid, the smaller number of equals; and how many vectors had to be fetched for it.

    A centroid whose interval starts after another one ends is out. Where one is left, cells have decided.
    Elsewhere the full vector's distance to the likeliest centroid ends most of the others' intervals.
    """
    k = len(centroids)
    bounds = np.zeros((len(cells), 2 * k), tables.dtype)
    for j in range(DIM):
        bounds += tables[j][cells[:, j]]
    low, high = bounds[:, :k], bounds[:, k:]
    meets = low <= high.min(axis=1, keepdims=True)
    best = meets.argmax(axis=1)
    open_ = np.flatnonzero(meets.sum(axis=1) > 1)
    if len(open_):
        x, low, meets = vectors[open_].astype(np.int64), low[open_].astype(np.int64), meets[open_]
        likely = np.where(meets, low, np.iinfo(np.int64).max).argmin(axis=1)
        reach = ((x - centroids[likely]) ** 2).sum(axis=1)
        row, c = np.nonzero(meets & (low <= reach[:, None]))
        distance = np.full(meets.shape, np.iinfo(np.int64).max)
        distance[row, c] = ((x[row] - centroids[c]) ** 2).sum(axis=1)
        best[open_] = distance.argmin(axis=1)
    return best, len(open_)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for ids, named, cells, vectors in zip(*[batch.column(n).to_pylist() for n in ("ids", "named", "cells", "vectors")], strict=True):
            yield np.frombuffer(ids, np.int64), np.frombuffer(named, bool), unpacked(cells), np.frombuffer(vectors, np.int32).reshape(-1, DIM)


def moved(file: DataFrame, centroids: np.ndarray, bounds: tuple) -> np.ndarray:
    """The centroids after one round: the floor of the mean of the vectors of each, where it has any."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, k = lookup(centroids, *bounds), len(centroids)
        total, many = np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        for _, _, cells, vectors in _blocks(batches):
            best, _ = nearest(cells, vectors, centroids, tables)
            for c in np.unique(best):
                total[c] += vectors[best == c].sum(axis=0, dtype=np.int64)
            many += np.bincount(best, minlength=k)
        c, j = np.nonzero(np.repeat(many[:, None] > 0, DIM, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(j), pa.array(many[c]), pa.array(total[c, j])], names=["cluster", "j", "n", "total"])

    parts = file.mapInArrow(sums, "cluster bigint, j bigint, n bigint, total bigint")
    out = centroids.copy()
    # A row for each centroid and dimension.
    for r in parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.j] = int(r.total) // r.n
    return out


def assigned(file: DataFrame, centroids: np.ndarray, bounds: tuple) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(centroids, *bounds)
        for ids, named, cells, vectors in _blocks(batches):
            best, _ = nearest(cells, vectors, centroids, tables)
            distance = ((vectors.astype(np.int64) - centroids[best]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return file.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: a row for each vector that takes part.

    Vectors are packed once into blocks of cells and full vectors, where they stay: a round reads the file and
    sends a sum for each centroid and task. Its distance intervals come from a table for each dimension;
    the full vector is looked at for a distance only where intervals of several centroids overlap.

    Vectors of another length, null, or with a null, non-finite or too large component (2^19 or more) take no part. Null
    vec_id: assigned, but never a first centroid. Repeated rows are each a vector; their first centroids are ordered by
    components. Fewer vectors than ``k``: as many centroids. Sums over a 64-bit number are null. Empty table: no rows.
    Other columns are ignored.
    """
    spark, rows = vectors.sparkSession, valid(vectors)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    bounds = edges(rows)
    file = cut(approximated(rows, bounds[0]))
    for _ in range(rounds):
        centroids = moved(file, centroids, bounds)
    found = cut(assigned(file, centroids, bounds))
    own = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    facts = [(c, fits(d), fits(sum(own.values())), ",".join(map(str, centroids[c].tolist()))) for c, d in own.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    away = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
              WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: isfinite(e) AND abs(e) < {LARGEST // 256})) = {DIM})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, min((d, c)) AS best FROM (SELECT v.i, c.c, {away} AS d FROM v CROSS JOIN c{r} c) GROUP BY i)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(f ORDER BY j) AS x FROM (SELECT c, j, (s - ((s % n) + n) % n) // n AS f FROM
              (SELECT best[2] AS c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (i), range(1, {DIM + 1}) t(j) GROUP BY ALL)) GROUP BY c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} c ON c.c = best[2]"""


ORACLE = _oracle()
