"""Toxicity by non-negative positive-unlabelled learning on bounded samples."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, held_out, slices, text_bytes

#: Bounds of the training sample (confirmed toxic documents, unlabelled documents) and of the vocabulary.
POSITIVES, UNLABELLED, VOCABULARY = 2000, 4000, 1024
#: Letters of the word beginnings that are features beside whole words: stems that take many endings.
STEMS = (3, 4, 5)
#: Least squared z-score of a feature's shares in the two samples; weaker ones are noise.
LEAST_Z2 = 16
#: Classifiers whose probabilities are averaged; each is trained on its own resample.
CLASSIFIERS = 3
_OTHER = re.compile(r"[\W\d_]+")
_CACHE = 100_000


class _Features(dict):
    """Hashes of each raw word's letters, lower-cased, and of its beginnings; none for words without a letter.

    With ``column`` (hash to number), the numbers of the hashes that it has.
    """

    def __init__(self, column: dict[int, int] | None = None) -> None:
        self.column = column

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        word = _OTHER.sub("", raw.decode("utf-8", "replace").lower())
        parts = [word, *(f"^{word[:k]}" for k in STEMS if len(word) >= k)] if word else []
        value = tuple(xxhash.xxh64_intdigest(x) >> 1 for x in parts)
        if self.column is not None:
            value = tuple(self.column[x] for x in value if x in self.column)
        self[raw] = value
        return value

    def of(self, text: bytes | None) -> set[int]:
        return {x for w in set((text or b"").split()) for x in self[w]}


def _token_rows(batches):
    features = _Features()
    for batch in slices(batches, "text", 4 << 20):
        found = [list(features.of(t)) for t in text_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("positive"), pa.array(found, pa.list_(pa.int64()))],
            names=["doc_id", "positive", "tokens"],
        )


def train(x: np.ndarray, positive: np.ndarray, prior: float, seed: int, steps: int = 400, rate: float = 0.05):
    """Weights and bias of one linear classifier under the non-negative PU risk.

    ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss; where the second part
    falls below zero, the step climbs it instead. ``x``: 0/1 features; rows not ``positive`` are unlabelled.
    """
    rng = np.random.default_rng(seed)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    xp, xu = x[rng.choice(p, len(p))], x[rng.choice(u, len(u))]
    theta = np.zeros(x.shape[1] + 1, np.float32)
    theta[-1] = -0.1
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def slope(rows, sign):
        """Mean sigmoid loss of ``sign * g`` and its gradient."""
        loss = 1 / (1 + np.exp(np.clip(sign * (rows @ theta[:-1] + theta[-1]), -60, 60)))
        d = -sign * loss * (1 - loss) / len(rows)
        return loss.mean(), np.append(d @ rows, d.sum())

    for step in range(1, steps + 1):
        up, gp = slope(xp, 1)
        down, gd = slope(xp, -1)
        unl, gu = slope(xu, -1)
        rest = unl - prior * down
        grad = prior * gp + (gu - prior * gd) if rest >= 0 else prior * gd - gu
        grad[:-1] += 1e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = VOCABULARY
) -> tuple[dict[int, int], np.ndarray]:
    """Vocabulary (token hash to feature, ``features`` at most) and classifiers (a row each, bias last).

    They are fitted on a sample of at most ``positives`` confirmed toxic and ``unlabelled`` unlabelled documents. Of
    several rows of one doc_id, the sample has the text of smallest hash.

    Confirmed toxic examples are rows of ``labels`` with toxic = 1; the unlabelled sample is drawn from
    all documents. Both are the first by a hash of doc_id, of the fold that may be learned from; the
    class prior is toxic's share of that fold's labels. Without any toxic example all scores are 0.
    """
    fold = ~held_out(F.col("doc_id"))
    known = labels.select("doc_id", "toxic").filter(fold & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return {}, np.full((1, 1), -20.0, np.float32)
    place = F.xxhash64("doc_id", F.lit("sample"))
    some = known.filter("toxic = 1").select("doc_id").distinct()
    some = some.orderBy(place, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    rest = docs.select("doc_id").filter(fold & F.col("doc_id").isNotNull()).distinct()
    rest = rest.orderBy(place, "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))
    # At most positives + unlabelled rows, so the broadcast is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(some.unionByName(rest)), "doc_id")
    # One row an id and half, merged before it is exchanged: repeats neither add to the sample nor meet in one task.
    sample = sample.groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = cut(sample.select("doc_id", "positive", "text").mapInArrow(_token_rows, "doc_id bigint, positive boolean, tokens array<bigint>"))
    n_pos, n = rows.agg(F.count_if("positive"), F.count("*")).first()
    n_unl = n - n_pos
    if not n_pos or not n_unl:
        return {}, np.full((1, 1), -20.0, np.float32)
    each = rows.select("doc_id", "positive", F.explode("tokens").alias("token"))
    share = each.groupBy("token").agg(
        (F.count_if("positive") / n_pos).alias("p"), (F.count_if(~F.col("positive")) / n_unl).alias("q"), F.count("*").alias("n")
    )
    # Both samples share one rate if the feature says nothing, so their pooled rate gives the variance: with few toxic
    # examples, a common word that none of them happens to hold is no evidence.
    gap, rate = F.col("p") - F.col("q"), F.col("n") / (n_pos + n_unl)
    z2 = gap * gap / F.greatest(rate * (1 - rate) * (1 / n_pos + 1 / n_unl), F.lit(1e-12))
    vocabulary = share.filter((F.col("n") >= 5) & (z2 >= LEAST_Z2)).orderBy(z2.desc(), "token").limit(features).select("token")
    column = {r.token: i for i, r in enumerate(vocabulary.collect())}
    picked = each.join(F.broadcast(vocabulary), "token").groupBy("doc_id", "positive")
    picked = rows.select("doc_id", "positive").join(picked.agg(F.collect_list("token").alias("t")), ["doc_id", "positive"], "left")
    found = picked.orderBy("doc_id", "positive").collect()
    x = np.zeros((len(found), len(column)), np.float32)
    for i, r in enumerate(found):
        x[i, [column[t] for t in r.t or ()]] = 1
    positive = np.array([r.positive for r in found])
    return column, np.stack([train(x, positive, prior, seed) for seed in range(CLASSIFIERS)])


def _scorer(column: dict[int, int], theta: np.ndarray):
    """Mean probability of the classifiers for one text."""
    features, weight, bias = _Features(column), theta[:, :-1], theta[:, -1]

    def score(text: bytes | None) -> float:
        at = sorted(features.of(text))
        g = weight[:, at].sum(axis=1) + bias if at else bias
        return float(np.mean(1 / (1 + np.exp(np.clip(-g.astype(np.float64), -60, 60)))))

    return score


def scored(docs: DataFrame, model: tuple[dict[int, int], np.ndarray]) -> DataFrame:
    """``doc_id, score`` of every row's whole text, by the words that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(*shared.value)
        for batch in slices(batches, "text", 4 << 20):
            scores = pa.array([score(t) for t in text_bytes(batch, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def clean(docs: DataFrame, model: tuple[dict[int, int], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under one half; text never leaves its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scorer(*shared.value)
        for batch in slices(batches, "text", 4 << 20):
            yield batch.filter(pa.array([score(t) < 0.5 for t in text_bytes(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The score is the mean probability of classifiers trained on confirmed toxic documents and unlabelled
    text; lang, source, labels and doc_id are no inputs. Null and empty texts get the score of a text
    without known words. Repeated rows are each scored. Null doc_id: held_out is null. Empty tables: no rows, or
    scores near 0 without labels. Other columns are ignored.
    """
    return scored(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
