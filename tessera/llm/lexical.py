"""Ranked lexical search: a term-document grid for each shard as a K2-treap, descended by all of an item's rows jointly."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import k2treap
from tessera.llm.blocks import Numbers, squeezed, unsqueezed
from tessera.llm.common import cut, slices, text_bytes

#: Text bytes of a shard, and items of a block and their text bytes (one item at least).
SHARD, ITEMS, ITEM_BYTES = 8 << 20, 256, 1 << 20
#: Items that descend together, which bounds a task's memory.
TOGETHER = 32
#: Groups of shards for each of the session's shuffle partitions: items go once to each group.
SPREAD = 2
#: ASCII letters and digits and all other bytes of UTF-8 belong to terms, of which A-Z is lower-cased; the rest parts them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_TABLE).split()


def weight(n: str, df: str):
    """A term's weight from the number of documents and those that hold it."""
    return F.floor(1000 * F.log((2 * F.col(n).cast("double") + 2) / (2 * F.col(df).cast("double") + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a document's score before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _number(at: int) -> int:
    """A number for a task's row, unlike those of other tasks."""
    return (TaskContext.get().partitionId() << 32) + at


def _binary(*columns) -> list[pa.Array]:
    return [pa.array([c], pa.binary()) for c in columns]


def postings(docs: DataFrame) -> DataFrame:
    """A row for each shard: documents with a term in order of doc_id, their lengths, terms by falling document frequency, and (term, document, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, lengths, tokens, size, shard = Numbers(), [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal numbers, ids, lengths, tokens, size, shard
            key = [i is None for i in ids], [i or 0 for i in ids]
            order = np.lexsort((np.array(key[1]), np.array(key[0])))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            n = np.array(lengths, np.int64)
            wide = len(numbers)
            pair, tf = np.unique(np.repeat(rank, n) * wide + np.concatenate(tokens), return_counts=True)
            column, term = np.divmod(pair, wide)
            df = np.bincount(term, minlength=wide)
            by = np.argsort(-df, kind="stable")
            row = np.empty(wide, np.int64)
            row[by] = np.arange(wide)
            words = list(numbers)
            out = _binary(
                np.array(key[1], np.int64)[order].tobytes(), (~np.array(key[0]))[order].tobytes(), b" ".join([words[i] for i in by]),
                squeezed(n[order], df[by]), squeezed(row[term], column, tf),
            )
            numbers_of = [pa.array([_number(shard)]), pa.array([len(ids)]), pa.array([int(n.sum())])]
            numbers, ids, lengths, tokens, size, shard = Numbers(), [], [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([*numbers_of, *out], names=["shard", "docs", "length", "ids", "named", "terms", "counts", "points"])

        for batch in slices(batches, "text", SHARD):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                if not (of := terms(text or b"")):
                    continue
                if size and size + len(text) > SHARD:
                    yield closed()
                ids.append(doc_id)
                lengths.append(len(of))
                tokens.append(np.fromiter(map(numbers.__getitem__, of), np.int32, len(of)))
                size += len(text)
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "shard bigint, docs bigint, length bigint, ids binary, named binary, terms binary, counts binary, points binary")


def treaps(shards: DataFrame, n: int, length: int) -> DataFrame:
    """Each shard's grid of impacts as a K2-treap; ``n`` documents with a term hold ``length`` terms in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, _ = unsqueezed(batch.column("counts")[i].as_py())
                row, column, tf = unsqueezed(batch.column("points")[i].as_py())
                # Python's numbers: the product may leave 64 bits.
                m = {x: 100 - 25 + 25 * x * n // length for x in np.unique(lengths).tolist()}
                m = np.fromiter(map(m.__getitem__, lengths.tolist()), np.int64, len(lengths))
                tree = k2treap.build(row, column, impact(tf.astype(np.int64), m[column]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("shard", "ids", "named", "terms")), *_binary(tree)], names=["shard", "ids", "named", "terms", "tree"])

    return shards.mapInArrow(run, "shard bigint, ids binary, named binary, terms binary, tree binary")


def item_blocks(items: DataFrame) -> DataFrame:
    """Items in blocks: for each its number ``tag``, ``item_id``, and its terms with their repeats."""
    ddl = "block bigint, items array<struct<tag: bigint, item_id: bigint, terms: array<struct<term: binary, n: bigint>>>>"
    kind = pa.list_(pa.struct([("tag", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.binary()), ("n", pa.int64())])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block, tag = [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal held, size, block
            out = pa.RecordBatch.from_arrays([pa.array([_number(block)]), pa.array([held], kind)], names=["block", "items"])
            held, size, block = [], 0, block + 1
            return out

        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                if not (of := terms(text or b"")):
                    continue
                if held and (len(held) >= ITEMS or size + len(text) > ITEM_BYTES):
                    yield closed()
                distinct: dict[bytes, int] = {}
                for t in of:
                    distinct[t] = distinct.get(t, 0) + 1
                held.append({"tag": _number(tag), "item_id": item_id, "terms": [{"term": t, "n": c} for t, c in distinct.items()]})
                size, tag = size + len(text), tag + 1
        if held:
            yield closed()

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, ddl)


def _met(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each shard with each block of items, which goes once to each group of shards."""
    groups = SPREAD * int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to_all = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Spark's estimate of the items' size does not count their copies, so it must not choose to broadcast them.
    return shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).join(to_all.hint("merge"), "group").drop("group")


def frequencies(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """``block, term, df``: documents of the corpus that hold each term of a block's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                place = {t: j for j, t in enumerate(batch.column("terms")[i].as_py().split(b" "))}
                _, df = unsqueezed(batch.column("counts")[i].as_py())
                asked = [t for t in batch.column("asked")[i].as_py() if t in place]
                block = batch.column("block")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(asked), pa.int64()), pa.array(asked, pa.binary()), pa.array(df[[place[t] for t in asked]].astype(np.int64))], names=["block", "term", "df"])

    asked = blocks.select("block", F.array_distinct(F.flatten(F.transform("items", lambda x: x["terms"]["term"]))).alias("asked"))
    parts = _met(shards.select("shard", "terms", "counts"), asked).mapInArrow(run, "block bigint, term binary, df bigint")
    return parts.groupBy("block", "term").agg(F.sum("df").alias("df"))


def found(index: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``tag, item_id, doc_id, score``: the ``k`` best documents of each shard for each item; ``weights`` are a block's terms and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                place = {t: j for j, t in enumerate(cell("terms").split(b" "))}
                weights = {w["term"]: w["w"] for w in cell("weights")}
                ids, named = np.frombuffer(cell("ids"), np.int64), np.frombuffer(cell("named"), bool)
                tree, items = k2treap.load(cell("tree")), cell("items")
                for at in range(0, len(items), TOGETHER):
                    part = items[at : at + TOGETHER]
                    rows = [(j, place[t["term"]], t["n"] * weights[t["term"]]) for j, x in enumerate(part) for t in x["terms"] if weights.get(t["term"]) and t["term"] in place]
                    item, row, heavy = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [])))
                    item, column, score = k2treap.search(tree, item, row, heavy, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[j]["tag"] for j in item], pa.int64()), pa.array([part[j]["item_id"] for j in item], pa.int64()), pa.array(ids[column], mask=~named[column]), pa.array(score)],
                        names=["tag", "item_id", "doc_id", "score"],
                    )

    return _met(index, blocks).mapInArrow(run, "tag bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``, highest first, equal scores by doc_id.

    Documents are indexed in shards where they are read; a shard's K2-treap has a row for each term and a column for
    each document, and a quadtree cell's value is the largest impact in it. Document frequencies and lengths are
    those of the whole corpus. Every block of items meets every shard, each shard answers with its ``k`` best, and these are merged.

    Null and empty texts have no terms: no such document is found or counted, no such item has rows. Null doc_id: after
    all others among equal scores. Repeated rows are documents of their own, repeated items each have their ranks. Empty tables:
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = cut(postings(docs))
    blocks = cut(item_blocks(items))
    n, length = shards.agg(F.sum("docs"), F.sum("length")).first()
    if not n:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    df = frequencies(shards, blocks).withColumn("n", F.lit(n))
    weights = df.groupBy("block").agg(F.collect_list(F.struct("term", weight("n", "df").alias("w"))).alias("weights"))
    index = cut(treaps(shards, n, length))
    rows = found(index, blocks.join(weights, "block"), k)
    best = Window.partitionBy("tag").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT d, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM low),
     docs AS (SELECT d, doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
     total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM docs),
     tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     asked AS (SELECT item_id, i, term, count(*) AS times FROM (SELECT item_id, i, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM (SELECT item_id, row_number() OVER () AS i, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)) GROUP BY ALL),
     part AS (SELECT item_id, i, d, times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                     * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // l))) AS s
              FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (d), total),
     score AS (SELECT item_id, i, d, sum(s)::BIGINT AS score FROM part GROUP BY item_id, i, d HAVING sum(s) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM score JOIN docs USING (d) QUALIFY rank <= 20
"""
