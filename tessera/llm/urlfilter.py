"""URL filters: rules first, then a ratio of two character language models."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import slices, text_bytes

#: (verdict, host and path) of the contract's rules. Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Longest context in bytes. A context stays in a model if at least one byte in so many of its class follows it,
#: so each order has at most that many contexts at any number of pages.
ORDER, SHARE = 5, 1 << 14
#: One accepted or rejected URL in so many calibrates the threshold instead of training.
CALIBRATE = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BINS, _WIDTH = 400, 0.02


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host (or a parent domain of it) and the path's start; else null."""
    found = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, text).otherwise(found)
    return found


_BYTE, _CONTEXT = np.int64(8), np.int64(48)


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``order, context, byte`` of each byte at each order, as one number (order, byte), and each byte's URL.

    A start mark stands before each URL and an end mark after it. The nearest byte of a context is its
    lowest, so a mask gives the shorter context.
    """
    data = np.frombuffer(b"".join(b"\x02" * ORDER + u + b"\x03" for u in urls), np.uint8).astype(np.int64)
    lens = np.fromiter(map(len, urls), np.int64, len(urls)) + 1
    of = np.repeat(np.arange(len(urls)), lens)
    at = np.arange(len(of)) + ORDER * (of + 1)
    context, out = np.zeros(len(of), np.int64), []
    for n in range(ORDER + 1):
        if n:
            context = context | data[at - n] << np.int64(8 * (n - 1))
        out.append(np.int64(n) << _CONTEXT | context << _BYTE | data[at])
    return np.array(out), of


class Markov:
    """A smoothed Markov model of variable order over bytes, from counts by ``grams``' numbers.

    Witten-Bell: a context gives its unseen bytes the weight of its number of distinct bytes, shared as
    the next shorter context has it; bytes in no context at all are equally likely. A context that the
    counts lack passes on to the shorter one. The probabilities of all bytes after a context sum to one.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order]
        self.contexts, of = np.unique(self.keys >> _BYTE, return_inverse=True)
        total, kinds = np.bincount(of, counts, len(self.contexts)), np.bincount(of, minlength=len(self.contexts))
        self.unseen = kinds / (total + kinds)
        self.p = np.zeros(len(keys))
        for n in range(ORDER + 1):
            a, b = np.searchsorted(self.keys, [n << int(_CONTEXT), (n + 1) << int(_CONTEXT)])
            mine = of[a:b]
            shorter = self.prob(self.shorter(self.keys[a:b], n), n - 1)
            self.p[a:b] = counts[a:b] / (total[mine] + kinds[mine]) + self.unseen[mine] * shorter

    @staticmethod
    def shorter(keys: np.ndarray, n: int) -> np.ndarray:
        """The same bytes after contexts without their farthest byte (of order ``n``)."""
        bits = 8 * max(n, 1)
        return (keys & np.int64((1 << bits) - 1)) | np.int64(max(n - 1, 0)) << _CONTEXT

    def prob(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Probability of each byte after its context of order ``n``."""
        if n < 0:
            return np.full(len(keys), 1 / 256)
        out, at = np.empty(len(keys)), np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out[seen] = self.p[at[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            some = keys[rest]
            out[rest] = self.prob(self.shorter(some, n), n - 1)
            if len(self.contexts):
                at = np.minimum(np.searchsorted(self.contexts, some >> _BYTE), len(self.contexts) - 1)
                known = self.contexts[at] == some >> _BYTE
                out[rest[known]] *= self.unseen[at[known]]
        return out


def log_likelihood(models: list[Markov], urls: list[bytes]) -> np.ndarray:
    """Mean log-probability of a byte of each URL (its end counts as one) under each model."""
    keys, of = grams(urls)
    sums = [np.bincount(of, np.log(m.prob(keys[ORDER])), len(urls)) for m in models]
    return np.array(sums) / (np.fromiter(map(len, urls), np.int64, len(urls)) + 1)


def _counted(batches):
    for batch in slices(batches, "url", 1 << 20):
        kind = batch.column("accepted").to_numpy(zero_copy_only=False).astype(bool)
        urls = text_bytes(batch, "url")
        for c in (False, True):
            mine = [u for u, k in zip(urls, kind, strict=True) if k == c]
            if mine:
                keys, n = np.unique(grams(mine)[0], return_counts=True)
                for i in range(0, len(keys), 50_000):
                    some = slice(i, i + 50_000)
                    columns = [pa.array(np.full(len(keys[some]), c)), pa.array(keys[some] >> _BYTE), pa.array(keys[some]), pa.array(n[some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["accepted", "context", "key", "n"])


def counted(labelled: DataFrame, share: int = SHARE) -> DataFrame:
    """``accepted, key, n``: exact counts of bytes after the contexts that a class's model keeps, over all of ``url, accepted``.

    A context is kept if more than one byte, and one in ``share`` of the class's bytes or more, follows it: a share
    of the data, so the kept contexts don't depend on its size, and an order has at most ``share`` of them.
    """
    seen = labelled.mapInArrow(_counted, "accepted boolean, context bigint, key bigint, n bigint")
    # Counts of a context meet in one place, at most one row a byte, and its total needs no further exchange.
    seen = seen.repartition("accepted", "context").groupBy("accepted", "context", "key").agg(F.sum("n").alias("n"))
    seen = seen.withColumn("total", F.sum("n").over(Window.partitionBy("accepted", "context")))
    bytes_ = labelled.groupBy("accepted").agg(F.sum(F.octet_length("url") + 1).alias("bytes"))
    # Two classes at most.
    kept = seen.join(F.broadcast(bytes_), "accepted").filter((F.col("total") > 1) & (F.col("total") * share >= F.col("bytes")))
    return kept.select("accepted", "key", "n")


def fit(labelled: DataFrame) -> tuple[list[Markov], float]:
    """Models of rejected and accepted URLs over all of ``url, accepted``, and the threshold that parts them best.

    The threshold is the midpoint of the log-likelihood differences with the best balanced accuracy on the
    URLs kept out of training, in bins of ``_WIDTH`` (0 where either class is missing).
    """
    aside = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0
    rows = labelled.filter(F.col("url").isNotNull()).select("url", "accepted")
    # Bounded by ORDER and SHARE, not by the pages.
    table = counted(rows.filter(~aside)).toArrow()
    kind, keys, n = (table.column(c).to_numpy() for c in ("accepted", "key", "n"))
    models = [Markov(keys[kind == c], n[kind == c]) for c in (False, True)]
    scores = scored(rows.filter(aside), models)
    bin_ = F.greatest(F.lit(-_BINS), F.least(F.lit(_BINS), F.floor(F.col("score") / _WIDTH))).cast("int").alias("bin")
    seen = scores.groupBy(bin_, "accepted").count().collect()
    shares = np.zeros((2, 2 * _BINS + 1))
    for r in seen:
        shares[int(r.accepted), r.bin + _BINS] = r["count"]
    if not shares.sum(axis=1).all():
        return models, 0.0
    shares /= shares.sum(axis=1, keepdims=True)
    # Blocked if under the edge: rejected URLs below it and accepted ones not below it are right.
    right = np.append(0, shares[0].cumsum()) - np.append(0, shares[1].cumsum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return models, float((best.mean() - _BINS) * _WIDTH)


def scored(rows: DataFrame, models: list[Markov]) -> DataFrame:
    """``rows`` with ``score``: accepted less rejected log-likelihood, a byte (0 for a null URL)."""
    shared = rows.sparkSession.sparkContext.broadcast([vars(m) for m in models])

    def run(batches):
        models = [Markov.__new__(Markov) for _ in shared.value]
        for model, arrays in zip(models, shared.value, strict=True):
            vars(model).update(arrays)
        for batch in slices(batches, "url", 1 << 20):
            urls = text_bytes(batch, "url")
            ll = log_likelihood(models, [u or b"" for u in urls])
            score = np.where([u is None for u in urls], 0.0, ll[1] - ll[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page's URL.

    Rules decide first, the longest that fits. URLs that rules accept or reject are the examples of two
    character models of variable order; where no rule fits, the URL is blocked if its log-likelihood
    difference a byte is under the calibrated threshold.

    Null URL: host and path empty, no rule, score 0, so it is allowed unless the threshold is positive. Repeated
    rows are each judged. Null page_id is kept. Empty table, or rules that fit nothing: no evidence,
    all differences are 0 and pages are allowed. Other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for kind, text in rules:
        verdict = F.when(F.col("rule") == text, kind).otherwise(verdict)
    rows = rows.withColumn("ruled", verdict)
    ruled = rows.filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("accepted"))
    models, threshold = fit(ruled)
    model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return scored(rows, models).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"), "score"
    )
