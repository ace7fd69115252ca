"""Registered results recomputed word by word from the models that made them, over whole tables."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, pseudo_likelihood, urlfilter

from .common import edge_docs

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _softmax_log(z, at):
    z = z.astype(np.float64)
    return z[at] - z.max() - np.log(np.exp(z - z.max()).sum())


def test_op6_scores_are_sums_over_words(spark, documents):
    blocks = pseudo_likelihood.encoded(documents)
    params = pseudo_likelihood.fit(blocks)
    got = {r.doc_id: r for r in pseudo_likelihood.scored(blocks, params).collect()}
    emb, w1, b1, w2, b2, w3, b3 = params
    texts = {r.doc_id: (r.text or "").encode().split() for r in documents.collect()}
    counts = Counter(w for words in texts.values() for w in words)
    top = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: pseudo_likelihood.TOP])}
    of = dict(zip(counts, pseudo_likelihood._class_of(list(counts), top).tolist(), strict=True))
    mass = Counter()
    for w, n in counts.items():
        mass[of[w]] += n
    edge, groups, side = pseudo_likelihood.CLASSES, pseudo_likelihood.GROUPS, pseudo_likelihood.SIDE
    assert set(got) == set(texts)
    for doc_id in sorted(texts, key=lambda i: len(texts[i]))[: len(texts) - len(texts) // 10]:  # the longest tenth would take minutes here
        words, total = texts[doc_id], 0.0
        classes = [of[w] for w in words]
        for i, w in enumerate(words):
            around = [classes[j] if 0 <= j < len(words) else edge for j in [*range(i - side, i), *range(i + 1, i + side + 1)]]
            hidden = np.maximum(np.concatenate([emb[c] for c in around]) @ w1 + b1, 0)
            group, member = divmod(classes[i], groups)
            total += _softmax_log(hidden @ w2 + b2, group) + _softmax_log(hidden @ w3[group] + b3[group * groups : (group + 1) * groups], member)
            total += np.log(counts[w] / mass[classes[i]])
        r = got[doc_id]
        assert r.n_words == len(words) and r.log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-3)
        assert r["mean"] == pytest.approx(total / max(1, len(words)), rel=1e-4, abs=1e-4)


def _best_labels(scores, switch):
    """Viterbi with a whole table of steps, a word at a time."""
    k = scores.shape[1]
    value, back = scores[0].astype(np.float64), []
    step = switch * (1 - np.eye(k))
    for row in scores[1:]:
        through = value[:, None] - step
        back.append(through.argmax(axis=0))
        value = through.max(axis=0) + row
    labels = [int(value.argmax())]
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    return labels[::-1], float(value.max())


def test_op2_predictions_are_those_of_the_best_path(spark, documents):
    model = langid.fit(documents)
    found = {r.doc_id: r for r in langid.labelled(documents, model).collect()}
    for r in documents.collect():
        bare = [langid.letters(w) for w in (r.text or "").encode().split()]
        mine = found[r.doc_id]
        if not sum(map(len, bare)):
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        scores = np.asarray(model.words(bare), np.float64)
        labels, best = _best_labels(scores, langid.SWITCH)
        theirs = [model.langs.index(s.lang) for s in mine.spans for _ in range(s.first, s.last + 1)]
        assert len(theirs) == len(bare)
        value = scores[np.arange(len(bare)), theirs].sum() - langid.SWITCH * sum(a != b for a, b in zip(theirs, theirs[1:], strict=False))
        assert value == pytest.approx(best, rel=1e-5, abs=0.05)  # the same path, or one as good
        mass = np.bincount(theirs, [len(b) for b in bare], len(model.langs))
        assert mine.lang_pred == model.langs[int(mass.argmax())] and mine.score == pytest.approx(mass.max() / mass.sum())
        if labels == theirs:
            assert sum(s.last - s.first + 1 for s in mine.spans) == len(labels)


def test_op5_threshold_is_the_best_and_verdicts_follow_it(spark):
    pages = spark.read.parquet(f"{os.path.dirname(SF)}/sf0.01/pages.parquet")
    judged = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    kinds = dict((text, kind) for kind, text in urlfilter.RULES)
    ruled = spark.createDataFrame([(r.url, kinds[judged[r.page_id].rule] == "allow") for r in pages.collect() if judged[r.page_id].rule], "url string, accepted boolean")
    models, threshold = urlfilter.fit(ruled)
    aside = ruled.filter(F.pmod(F.xxhash64("url"), F.lit(urlfilter.CALIBRATE)) == 0).collect()
    score = lambda url: float(np.subtract(*urlfilter.log_likelihood(models, [url.encode()])[::-1, 0]))
    marks = [(score(r.url), r.accepted) for r in aside]

    def accuracy(t):
        return sum(np.mean([(s < t) != kind for s, k in marks if k == kind]) for kind in (False, True)) / 2

    edges = np.arange(-400, 401) * 0.02
    assert accuracy(threshold) >= max(map(accuracy, edges)) - 0.02  # a bin's width
    for r in pages.collect():
        mine = judged[r.page_id]
        assert mine.score == pytest.approx(score(r.url), abs=1e-9)
        assert mine.verdict == (kinds[mine.rule] if mine.rule else "block" if mine.score < threshold else "allow")


def test_mixing_and_encoding_stages_take_edge_rows(spark, tmp_path):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    twice = docs.unionByName(docs.filter("doc_id = 1").withColumn("source", F.lit("z")))
    mixed = corpus_pipeline.mix_sources(spark, twice, str(tmp_path))
    copies = Counter((r.doc_id, r.source) for r in mixed.collect())
    # Documents without a word go; rows of one id are taken alike, in whatever source they are.
    assert not any(i in (3, 4, 5) for i, _ in copies) and copies[1, "a"] == copies[1, "z"]
    encoded = corpus_pipeline.encode(spark, docs, str(tmp_path))
    assert encoded.columns == ["doc_id", "n_pieces", "ids"]
    rows = encoded.collect()
    assert len(rows) == docs.count() and all(r.n_pieces == len(r.ids) for r in rows)
    assert all((r.n_pieces == 0) == (r.doc_id in (3, 4)) for r in rows)
    assert corpus_pipeline.encode(spark, docs.limit(0), str(tmp_path)).collect() == []
