"""SimHash near-dedup: fingerprints linked through a Gray-order hierarchical index."""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, met, slices, text_bytes
from tessera.llm.components import components

BITS, SEED = 64, 42
#: Fingerprints in a leaf of the index, and leaves under one inner node.
LEAF, FANOUT = 256, 16
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


# ---- fingerprints ----


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of one text, as an unsigned number: the majority of each bit over its shingles."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for i in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, key: Column | None = None) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed number. A string ``key`` is passed on."""
    keys = [] if key is None else [key.cast("string").alias("key")]

    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch, "text")], np.uint64).view(np.int64)
            passed = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), pa.array(fps)], names=[*passed, "fp"])

    ddl = "doc_id bigint, " + ("key string, " if keys else "") + "fp bigint"
    return docs.select(F.col("doc_id").cast("bigint"), *keys, "text").mapInArrow(run, ddl)


# ---- the index ----


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Rank of each pattern in the Gray order: neighbours in it differ in few bits."""
    rank = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _rank(fp: Column) -> Column:
    """``gray_rank`` as a column."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def masks(n: int, most: int) -> list[int]:
    """Top patterns' masks: any two fingerprints within ``most`` bits agree under at least one of them.

    The bits are cut into ``most + keep`` blocks; of these at least ``keep`` stay untouched. More blocks
    are kept as fingerprints grow in number, so that a top node holds few of them at any size.
    """
    keep = 1
    while keep < 4 and n / 2.0 ** (BITS * keep / (most + keep)) > 4096:
        keep += 1
    edges = [round(BITS * i / (most + keep)) for i in range(most + keep + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(most + keep)]
    return [sum(c) for c in combinations(blocks, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(fp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run that begins at ``starts``: the shared bits' values, and the mask of shared bits."""
    ones, zeros = np.bitwise_and.reduceat(fp, starts), np.bitwise_and.reduceat(~fp, starts)
    return ones, ones | zeros


def _pairs(a, b, most: int, same: bool):
    """Pairs of nodes that differ in at most ``most`` of the bits that both share."""
    (va, ma), (vb, mb) = a, b
    apart = np.bitwise_count((va[:, None] ^ vb[None, :]) & ma[:, None] & mb[None, :])
    i, j = np.nonzero(apart <= most)
    return (i[i <= j], j[i <= j]) if same else (i, j)


def linked(x: np.ndarray, y: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two leaves' Gray-sorted fingerprints (``y`` None: inside one leaf).

    Groups of ``FANOUT`` neighbours hold the pattern they share; a pair of groups that differs in more
    than ``most`` shared bits is pruned whole, and only the groups left are compared one by one.
    """
    same = y is None
    other = x if same else y
    sx, sy = np.arange(0, len(x), FANOUT), np.arange(0, len(other), FANOUT)
    left, right = [], []
    gi, gj = _pairs(_nodes(x, sx), _nodes(other, sy), most, same)
    for g in np.unique(gi):
        mine = x[sx[g] : sx[g] + FANOUT]
        at = (sy[gj[gi == g]][:, None] + np.arange(FANOUT)).ravel()
        theirs = other[at[at < len(other)]]
        i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= most)
        keep = mine[i] != theirs[j]
        left.append(mine[i[keep]])
        right.append(theirs[j[keep]])
    if not left:
        return x[:0], x[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value with the smallest value of its component, instead of all links of one node."""
    if not len(left):
        return left, right
    names, at = np.unique(np.concatenate([left, right]).view(np.int64), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _leaves(most_rows: int):
    def run(batches):
        mask, fps = None, []

        def leaf():
            fp = np.concatenate(fps)
            value, shared = _nodes(fp, np.array([0]))
            return {"mask": mask[0], "pattern": mask[1], "leaf": int(fp[0].view(np.int64)), "value": int(value.view(np.int64)[0]), "shared": int(shared.view(np.int64)[0]), "fps": fp.tobytes()}

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", "fp")]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            out = []
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(cols[0])], strict=True):
                key = (int(cols[0][a]), int(cols[1][a]))
                if key != mask and fps:
                    out.append(leaf())
                    fps = []
                mask = key
                for i in range(a, b, most_rows):
                    fps.append(cols[2][i : min(b, i + most_rows)].view(np.uint64))
                    if sum(map(len, fps)) >= most_rows:
                        out.append(leaf())
                        fps = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_LEAF_SCHEMA)
        if fps:
            yield pa.RecordBatch.from_pylist([leaf()], schema=_LEAF_SCHEMA)

    return run


_LEAF_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("mask", "pattern", "leaf", "value", "shared")] + [("fps", pa.binary())]
)
_LEAF_DDL = "mask bigint, pattern bigint, leaf bigint, value bigint, shared bigint, fps binary"


def _read(blob) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _inside(most: int):
    def run(batches):
        for batch in batches:
            found = [linked(_read(f), None, most) for f in batch.column("fps").to_pylist()]
            yield _edges(found)

    return run


def _between(most: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("fps").to_pylist(), batch.column("fps2").to_pylist(), strict=True)
            yield _edges([linked(_read(f), _read(g), most) for f, g in pairs])

    return run


def _edges(found) -> pa.RecordBatch:
    a = np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x, _ in found]])
    b = np.concatenate([np.zeros(0, np.int64), *[y.view(np.int64) for _, y in found]])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, most: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints that keep every component whole.

    ``fps`` holds distinct ``fp``. Top nodes of the index are masked patterns, so placed that any link
    lies under one of them. Under a top node, fingerprints in Gray order fill leaves of ``LEAF``; each
    leaf keeps the bits that all of it shares. A top node with many leaves is range-partitioned like the
    rest; its leaves have upper nodes, and pairs of leaves are found by going down from these.
    A leaf or a pair of leaves gives a forest of its links, so output stays linear in fingerprints.
    """
    n = fps.count()
    tops = masks(n, most)
    top = F.explode(F.array(*[F.lit(_signed(m)) for m in tops])).alias("mask")
    rows = fps.select("fp", _rank(F.col("fp")).alias("rank")).select("fp", "rank", top)
    rows = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
    # Only a pattern that some other fingerprint has too can hold a link.
    shared = rows.groupBy("mask", "pattern").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(shared, ["mask", "pattern"]).repartitionByRange("mask", "pattern", "rank")
    rows = rows.sortWithinPartitions("mask", "pattern", "rank").select("mask", "pattern", "fp")
    leaves = cut(rows.mapInArrow(_leaves(LEAF), _LEAF_DDL))
    inside = leaves.select("fps").mapInArrow(_inside(most), "a bigint, b bigint")
    order = Window.partitionBy("mask", "pattern").orderBy(_rank(F.col("leaf")))
    heads = cut(leaves.select("mask", "pattern", "leaf", "value", "shared", (F.row_number().over(order) - 1).alias("node")))
    near = _near_leaves(heads, most)
    blobs = heads.select("mask", "pattern", "leaf", "node").join(leaves.select("mask", "pattern", "leaf", "fps"), ["mask", "pattern", "leaf"])
    blobs = blobs.select("mask", "pattern", "node", "fps")
    near = near.join(blobs, ["mask", "pattern", "node"])
    near = near.join(blobs.select("mask", "pattern", F.col("node").alias("node2"), F.col("fps").alias("fps2")), ["mask", "pattern", "node2"])
    between = near.select("fps", "fps2").mapInArrow(_between(most), "a bigint, b bigint")
    return inside.unionByName(between).distinct()


def _near_leaves(heads: DataFrame, most: int) -> DataFrame:
    """``mask, pattern, node, node2``: pairs of leaves of one top node that differ in ``most`` shared bits or fewer.

    ``FANOUT`` neighbouring nodes have a parent that holds the bits they share, up to one level of at most ``FANOUT``
    nodes under a top node. Pairs go down from there; a pair of nodes that is too far apart ends with all below it.
    """
    key = ["mask", "pattern"]
    most_nodes = (heads.agg(F.max("node")).first()[0] or 0) + 1
    levels = [heads.select(*key, "node", "value", "shared")]
    while most_nodes > FANOUT:
        most_nodes = -(-most_nodes // FANOUT)
        zeros = F.expr("bit_and(~value & shared)")
        up = levels[-1].groupBy(*key, F.expr(f"node div {FANOUT}").cast("int").alias("node")).agg(F.bit_and("value").alias("value"), zeros.alias("zeros"))
        levels.append(up.select(*key, "node", "value", F.expr("value | zeros").alias("shared")))
    pairs, leaf = None, len(levels) - 1
    for level in reversed(levels):
        left = level.withColumn("up", F.expr(f"node div {FANOUT}").cast("int"))
        right = left.select(*key, *[F.col(c).alias(f"{c}2") for c in ("up", "node", "value", "shared")])
        if pairs is None:
            pairs = left.join(right, key)
        else:
            pairs = pairs.join(left, [*key, "up"]).join(right, [*key, "up2"])
        apart = F.bit_count(F.expr("(value ^ value2) & shared & shared2"))
        # A leaf with itself is done inside; an upper node has pairs of its own children.
        pairs = pairs.filter((F.col("node") < F.col("node2") if not leaf else F.col("node") <= F.col("node2")) & (apart <= most))
        pairs = pairs.select(*key, "node", "node2") if not leaf else pairs.select(*key, F.col("node").alias("up"), F.col("node2").alias("up2"))
        leaf -= 1
    return pairs


def members(docs: DataFrame, shingle: int = 4, most: int = 4, key: Column | None = None) -> DataFrame:
    """``doc_id, fp, component, component_id`` (and ``key``) of every row.

    ``component`` names a component even where its rows have no doc_id, or share one with other components' rows.
    """
    prints = cut(fingerprints(docs, shingle, key))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = cut(links(nodes.select("fp"), most))
    label = components(found).withColumnRenamed("node", "fp")
    nodes = cut(nodes.join(label, "fp", "left"))
    # Most nodes have no link and are components of their own; only the others ask for their component's smallest.
    linked = nodes.filter("component IS NOT NULL")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = met(linked, ids, "component", "fp").select("fp", "component", "component_id")
    alone = nodes.filter("component IS NULL").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"))
    return met(prints, linked.unionByName(alone), "fp", "doc_id")


def near_dups(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents linked where fingerprints differ in ``most`` bits or fewer.

    Rows of one fingerprint are one node from the start (copies are never paired); nodes are linked
    through the index, and components of links give each document the smallest doc_id it reaches.

    Null and empty texts and texts of white space: fingerprint zero, linked like any other. Null doc_id:
    a row like others, never the smallest where another is not null. Repeated rows: each is returned.
    Empty table: no rows. Other columns are ignored.
    """
    return members(docs, shingle, most).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def brute_force(rows: pd.DataFrame, shingle: int = 4, most: int = 4) -> dict[int, int]:
    """component_id by doc_id, by comparing all pairs: for tests."""
    ids = rows["doc_id"].tolist()
    fp = np.array([fingerprint(t.encode() if t is not None else None, shingle) for t in rows["text"]], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= most
    root = np.array(ids)
    while True:
        new = np.array([root[near[i]].min() for i in range(len(ids))])
        if np.array_equal(new, root):
            return dict(zip(ids, root.tolist(), strict=True))
        root = new
