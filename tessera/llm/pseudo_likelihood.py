"""LM scoring by masked pseudo-likelihood: a bidirectional window network trained in numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK, SPREAD, Numbers, bucketed, squeezed, unsqueezed
from tessera.llm.blocks import BUCKETS as SPLIT
from tessera.llm.common import cut, slices, text_bytes

#: Words on either side that a prediction sees; sizes of embeddings and of the hidden layer.
SIDE, EMBED, HIDDEN = 2, 16, 32
#: Classes are GROUPS x GROUPS: the most frequent words have one each, all others share BUCKETS by hash.
GROUPS, BUCKETS = 32, 256
CLASSES = GROUPS * GROUPS
TOP = CLASSES - BUCKETS
#: Tokens of a training step and of a scoring step; learning rate; documents of the warm start.
STEP, SCORE_STEP, RATE, WARM = 4096, 16384, 0.01, 400
#: Models averaged into one by one task of a round of averaging.
FAN_IN = 8
_SHAPES = [(CLASSES + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, GROUPS), (CLASSES,)]


# ---- the network ----


def initial(seed: int = 3) -> list[np.ndarray]:
    """Embeddings (the last is the edge of a text), hidden layer, group layer, layers inside each group."""
    rng = np.random.default_rng(seed)
    scale = [0.3, (2 * SIDE * EMBED) ** -0.5, 0, HIDDEN**-0.5, 0, HIDDEN**-0.5, 0]
    return [(rng.standard_normal(s) * c).astype(np.float32) for s, c in zip(_SHAPES, scale, strict=True)]


def windows(tokens: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Classes of the ``SIDE`` words before and after each word; past the text's ends, the edge."""
    starts = np.repeat(np.cumsum(lens) - lens, lens)
    ends = np.repeat(np.cumsum(lens), lens)
    place = np.arange(len(tokens))
    out = np.full((len(tokens), 2 * SIDE), CLASSES, np.int32)
    for j, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = place + shift
        ok = (at >= starts) & (at < ends)
        out[ok, j] = tokens[at[ok]]
    return out


def _exps(z):
    """``z`` less its rows' greatest, its exponentials and their sums."""
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones((e.shape[1], 1), e.dtype)


def _by_group(around, target):
    """Order of the targets' groups, both in it, and where each group begins. Small numbers sort by radix."""
    target = target.astype(np.uint16)
    order = np.argsort(target // GROUPS, kind="stable")
    target = target[order]
    return order, around[order], target, np.searchsorted(target // GROUPS, np.arange(GROUPS + 1))


def _forward(params, around, target, bounds):
    """Embeddings, hidden layer and scores of groups and members; the targets stand in order of their groups."""
    emb, w1, b1, w2, b2, w3, b3 = params
    x = emb[around].reshape(len(around), -1)
    hidden = x @ w1
    hidden += b1
    np.maximum(hidden, 0, out=hidden)
    z = np.empty((len(target), GROUPS), np.float32)
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if b > a:
            z[a:b] = hidden[a:b] @ w3[g] + b3[g * GROUPS : (g + 1) * GROUPS]
    return x, hidden, hidden @ w2 + b2, z


def log_probs(params, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target class given the words around it."""
    order, around, target, bounds = _by_group(around, target)
    *_, group, member = _forward(params, around, target, bounds)
    at, sums = np.arange(len(target)), np.zeros(len(target))
    for scores, one in ((group, target // GROUPS), (member, target % GROUPS)):
        z, _, total = _exps(scores)
        sums += z[at, one] - np.log(total[:, 0])
    out = np.empty(len(target))
    out[order] = sums
    return out


def gradients(params, around: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean negative log-probability."""
    emb, w1, _, w2, _, w3, _ = params
    _, around, target, bounds = _by_group(around, target)
    x, hidden, group, member = _forward(params, around, target, bounds)
    n, at = len(target), np.arange(len(target))
    slopes = []
    for scores, one in ((group, target // GROUPS), (member, target % GROUPS)):
        _, d, total = _exps(scores)
        d /= total
        d[at, one] -= 1
        d /= n
        slopes.append(d)
    d_group, d_member = slopes
    d_hidden = d_group @ w2.T
    g3, gb3 = np.zeros_like(w3), np.zeros(CLASSES, np.float32)
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if b > a:
            g3[g] = hidden[a:b].T @ d_member[a:b]
            gb3[g * GROUPS : (g + 1) * GROUPS] = d_member[a:b].sum(axis=0)
            d_hidden[a:b] += d_member[a:b] @ w3[g].T
    d_hidden *= hidden > 0
    d_x = (d_hidden @ w1.T).reshape(-1, EMBED)
    flat = around.astype(np.uint16).ravel()
    by = np.argsort(flat, kind="stable")
    flat = flat[by]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    g_emb = np.zeros_like(emb)
    g_emb[flat[starts]] = np.add.reduceat(d_x[by], starts, axis=0)
    return [g_emb, x.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_group, d_group.sum(axis=0), g3, gb3]


class Trainer:
    """Adam over steps of ``STEP`` tokens; what is left over waits for the next documents."""

    def __init__(self, params: list[np.ndarray]) -> None:
        self.params = [p.copy() for p in params]
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))
        self.steps = self.tokens = 0
        self.rest = (np.zeros((0, 2 * SIDE), np.int32), np.zeros(0, np.int64))

    def see(self, tokens: np.ndarray, lens: np.ndarray, flush: bool = False) -> None:
        around = np.concatenate([self.rest[0], windows(tokens, lens)])
        target = np.concatenate([self.rest[1], tokens])
        end = len(target) if flush else len(target) - len(target) % STEP
        # Steps mix documents: every so-manieth token of the slice.
        n_steps = -(-end // STEP)
        for i in range(n_steps):
            self._step(around[i:end:n_steps], target[i:end:n_steps])
        self.rest = around[end:], target[end:]

    def _step(self, around, target) -> None:
        self.steps += 1
        self.tokens += len(target)
        rate = RATE / (1 + self.steps / 500) ** 0.5
        for p, m, v, g in zip(self.params, self.m, self.v, gradients(self.params, around, target), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)


# ---- blocks of documents, and what the corpus says about their words ----

#: ``k`` is a block's number on its documents' row, and -1 - bucket on the rows of its distinct words and their counts.
_DEALT = "k bigint, block bigint, data binary, counts binary"
_TOTALS = "k bigint, words binary, totals binary"
_ENCODED = "block bigint, ids binary, lens binary, classes binary, shares binary"


def _wide(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as pairs of 32-bit ones."""
    return np.ascontiguousarray(x).view(np.int32)


def _blocks(buckets: int):
    """Per block: a row of its documents as numbers of words, and a row a bucket of its distinct words with their counts."""

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        numbers, docs, ids, held = Numbers(), [], [], 0

        def flush():
            block, tokens, words = part * (1 << 20) + serial, np.concatenate(docs), list(numbers)
            place, full, rows = bucketed(words, buckets)
            counts = np.empty(len(words), np.int64)
            counts[place] = np.bincount(tokens, minlength=len(words))
            ends = np.cumsum([r.count(b" ") + 1 for r in rows]).astype(np.int64)
            each = [squeezed(_wide(c)) for c in np.split(counts, ends[:-1])] if rows else []
            own, known = np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids])
            rows.append(squeezed(_wide(own), known, np.array([len(d) for d in docs]), tokens, place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(-1 - full, block), pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary()), pa.array([*each, b""], pa.binary())],
                names=["k", "block", "data", "counts"],
            )

        for batch in slices(batches, "text", BLOCK // 4):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                found = (text or b"").split()
                docs.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                held += len(text or b"") + 1
            if held > BLOCK:
                yield from flush()
                serial += 1
                numbers, docs, ids, held = Numbers(), [], [], 0
        if docs:
            yield from flush()

    return run


def _totals(packs: pa.Table) -> pa.Table:
    """A bucket's words and how often each occurs in all documents."""
    total: dict[bytes, int] = {}
    for words, counts in zip(packs.column("data").to_pylist(), packs.column("counts").to_pylist(), strict=True):
        for word, n in zip(words.split(b" "), unsqueezed(counts)[0].view(np.int64).tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    counts = squeezed(_wide(np.fromiter(total.values(), np.int64, len(total))))
    return pa.table([packs.column("k").slice(0, 1), pa.array([b" ".join(total)], pa.binary()), pa.array([counts], pa.binary())], names=["k", "words", "totals"])


def _read(words: bytes, totals: bytes) -> tuple[list[bytes], np.ndarray]:
    return words.split(b" "), unsqueezed(totals)[0].view(np.int64)


def _top(batches):
    """The words of a batch's buckets that can be among the ``TOP`` of all."""
    for batch in batches:
        for words, totals in zip(batch.column("words").to_pylist(), batch.column("totals").to_pylist(), strict=True):
            names, n = _read(words, totals)
            few = np.argsort(-n, kind="stable")
            few = few[n[few] >= n[few[: TOP][-1]]]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in few.tolist()], pa.binary()), pa.array(n[few])], names=["word", "n"])


def _class_of(words: list[bytes], top: dict[bytes, int]) -> np.ndarray:
    """Class of each word: its own, or that of its hash bucket."""
    return np.fromiter((top[w] if w in top else TOP + xxhash.xxh64_intdigest(w, 42) % BUCKETS for w in words), np.int32, len(words))


def _class_sums(top: dict[bytes, int]):
    def run(batches):
        sums = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for words, totals in zip(batch.column("words").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                names, n = _read(words, totals)
                np.add.at(sums, _class_of(names, top), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums)], names=["class", "n"])

    return run


def _returned(top: dict[bytes, int], sums: np.ndarray):
    """For each row of a bucket's words: their classes and the logs of their shares of these, in the same order, addressed to its block."""

    def run(packs: pa.Table, totals: pa.Table) -> pa.Table:
        words, n = _read(totals.column("words")[0].as_py(), totals.column("totals")[0].as_py())
        of = _class_of(words, top)
        share = np.log(n / np.maximum(sums[of], 1)).astype(np.float32).view(np.int32)
        at = {w: i for i, w in enumerate(words)}
        out = []
        for row in packs.column("data").to_pylist():
            own = np.fromiter(map(at.__getitem__, row.split(b" ")), np.int64)
            out.append(squeezed(of[own], share[own]))
        return pa.table([packs.column("block"), pa.compute.subtract(-1, packs.column("k")), pa.array(out, pa.binary())], names=["k", "bucket", "data"])

    return run


def _encoded(docs: pa.Table, found: pa.Table) -> pa.Table:
    """A block's documents: ids, lengths, the class of each word, and each document's sum of logs of shares."""
    own, known, lens, tokens, place = unsqueezed(docs.column("data")[0].as_py())
    parts = [unsqueezed(x) for x in found.sort_by("bucket").column("data").to_pylist()]
    none = [np.zeros(0, np.int32)]
    of = np.concatenate([p[0] for p in parts] or none)[place][tokens]
    share = np.concatenate([p[1] for p in parts] or none).view(np.float32)[place][tokens]
    sums = np.bincount(np.repeat(np.arange(len(lens)), lens), share, len(lens)).astype(np.float64)
    row = [docs.column("k").slice(0, 1), *(pa.array([squeezed(*x)], pa.binary()) for x in ((own, known), (lens,), (of,), (_wide(sums),)))]
    return pa.table(row, names=["block", "ids", "lens", "classes", "shares"])


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of all documents: ``block, ids, lens, classes, shares``, written to the shared folder.

    Every distinct word of the corpus is counted, in buckets by hash. The ``TOP`` most frequent words are classes
    of their own; all others share ``BUCKETS`` classes, in which each has the share of its count. One exchange
    deals blocks and buckets; a word that every document holds is one of a block's words, so no key is hot.
    """
    spark = docs.sparkSession
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    # Written once: counting, and what follows from the counts, read the same blocks.
    dealt = cut(rows.mapInArrow(_blocks(SPLIT * parts), _DEALT))
    packs = dealt.filter("k < 0").repartition(parts, "k")
    totals = cut(packs.groupBy("k").applyInArrow(_totals, _TOTALS))
    most = totals.select("words", "totals").mapInArrow(_top, "word binary, n bigint").orderBy(F.col("n").desc(), "word").limit(TOP).collect()
    top = {bytes(r.word): i for i, r in enumerate(most)}
    sums = np.zeros(CLASSES, np.int64)
    for r in totals.select("words", "totals").mapInArrow(_class_sums(top), "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        sums[r["class"]] = r.n
    found = packs.select("k", "block", "data").groupBy("k").cogroup(totals.withColumnRenamed("k", "of").groupBy("of"))
    found = found.applyInArrow(_returned(top, sums), "k bigint, bucket bigint, data binary")
    blocks = dealt.filter("k >= 0").select("k", "block", "data").groupBy("k").cogroup(found.withColumnRenamed("k", "to").groupBy("to"))
    return cut(blocks.applyInArrow(_encoded, _ENCODED))


# ---- training and scoring on Spark ----

_MODEL = "part bigint, weight double, params binary"
_SCHEMA = pa.schema([("part", pa.int64()), ("weight", pa.float64()), ("params", pa.binary())])
_SLICE = 1 << 20


def _pieces(batch: pa.RecordBatch, most_docs: int | None = None):
    """Classes and lengths of each block's documents, about ``_SLICE`` words at a time."""
    for i in range(batch.num_rows):
        (tokens,), (lens,) = (unsqueezed(batch.column(c)[i].as_py()) for c in ("classes", "lens"))
        lens = lens[:most_docs]
        ends = np.concatenate([[0], np.cumsum(lens)])
        a = 0
        while a < len(lens):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _SLICE, "right")) - 1)
            yield i, a, b, tokens[ends[a] : ends[b]].astype(np.int64), lens[a:b].astype(np.int64)
            a = b


def _train(flat: bytes, most_docs: int | None = None):
    def run(batches):
        trainer = Trainer(unpacked(flat))
        for batch in batches:
            for *_, tokens, lens in _pieces(batch, most_docs):
                trainer.see(tokens, lens)
        trainer.see(np.zeros(0, np.int64), np.zeros(0, np.int64), flush=True)
        row = {"part": TaskContext.get().partitionId(), "weight": float(trainer.tokens), "params": packed(trainer.params)}
        yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return run


def packed(params: list[np.ndarray]) -> bytes:
    return b"".join(p.astype(np.float32).tobytes() for p in params)


def unpacked(blob: bytes) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(blob, np.float32), [], 0
    for shape in _SHAPES:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def _averaged(table: pa.Table) -> pa.Table:
    weight = table.column("weight").to_numpy()
    total = np.zeros(sum(int(np.prod(s)) for s in _SHAPES))
    for w, blob in zip(weight, table.column("params").to_pylist(), strict=True):
        total += w * np.frombuffer(blob, np.float32)
    mean = (total / max(weight.sum(), 1)).astype(np.float32)
    row = {"part": table.column("part")[0].as_py() // FAN_IN, "weight": float(weight.sum()), "params": mean.tobytes()}
    return pa.Table.from_pylist([row], schema=_SCHEMA)


def fit(blocks: DataFrame) -> list[np.ndarray]:
    """Parameters learned from every word of every document of ``encoded`` blocks.

    A short warm start on up to ``WARM`` documents of one block (the first by a hash) gives all partitions one
    starting point. Then each partition trains on all its blocks, and the models are averaged, weighted by
    their words, in a tree: no task ever holds more than ``FAN_IN`` of them.
    """
    words = blocks.select("block", "classes", "lens")
    # The block is chosen by its number alone, so that only one block's words travel.
    first = blocks.select("block").orderBy(F.xxhash64("block", F.lit("warm")), "block").first()
    first = words.filter(F.col("block") == (first.block if first else -1))
    start = first.select("classes", "lens").mapInArrow(_train(packed(initial()), WARM), _MODEL).filter("weight > 0").first()
    start = bytes(start.params) if start else packed(initial())
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trained = cut(words.repartition(parts, "block").select("classes", "lens").mapInArrow(_train(start), _MODEL).filter("weight > 0"))
    last = trained.agg(F.max("part")).first()[0]
    if last is None:
        return unpacked(start)
    models, parts = trained, last + 1
    while parts > 1:
        models = models.groupBy(F.expr(f"part div {FAN_IN}").alias("to")).applyInArrow(_averaged, _MODEL)
        parts = -(-parts // FAN_IN)
    return unpacked(bytes(models.first().params))


def scored(blocks: DataFrame, params: list[np.ndarray]) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean``: each word predicted from both sides, summed over the text."""
    shared = blocks.sparkSession.sparkContext.broadcast(packed(params))

    def run(batches):
        params = unpacked(shared.value)
        for batch in batches:
            for i, a, b, tokens, lens in _pieces(batch):
                own, known = unsqueezed(batch.column("ids")[i].as_py())
                (shares,) = unsqueezed(batch.column("shares")[i].as_py())
                around = windows(tokens, lens)
                each = np.zeros(len(tokens))
                for j in range(0, len(tokens), SCORE_STEP):
                    each[j : j + SCORE_STEP] = log_probs(params, around[j : j + SCORE_STEP], tokens[j : j + SCORE_STEP])
                total = np.bincount(np.repeat(np.arange(len(lens)), lens), each, len(lens)) + shares.view(np.float64)[a:b]
                mean = np.where(lens > 0, total / np.maximum(lens, 1), 0.0)
                ids = pa.array(own.view(np.int64)[a:b], mask=~known[a:b].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lens), pa.array(total), pa.array(mean)], names=["doc_id", "n_words", "log_likelihood", "mean"])

    return blocks.drop("block").mapInArrow(run, "doc_id bigint, n_words bigint, log_likelihood double, mean double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Masked pseudo-log-likelihood of every row's whole text, by a network trained on all of ``docs``.

    A word's probability is its class's, given the ``SIDE`` words on either side, times the word's share of
    the class by its count in all documents. Null and empty texts: 0 words, log-likelihood and mean 0. Repeated
    rows are each scored and trained on. Null doc_id is kept. Empty table: no rows. Other columns are ignored.
    """
    blocks = encoded(docs)
    return scored(blocks, fit(blocks))
