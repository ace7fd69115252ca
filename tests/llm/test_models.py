import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, pseudo_likelihood, toxicity, urlfilter

from .common import edge_docs

WORDS = {"en": "the of and that which with from", "de": "der die und nicht ein mit von", "el": "και το να που δεν για"}


def _speech(spark, n=240):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS[k].split(), 25)), k) for i, k in ((i, list(WORDS)[i % 3]) for i in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_learns_and_marks_spans(spark):
    docs = _speech(spark)
    model = langid.fit(docs)
    assert model.langs == ["de", "el", "en"]
    rows = langid.language_id(docs).join(docs.drop("text"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in rows)
    mixed = "the of and that which der die und nicht ein και το να"
    (r,) = langid.labelled(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, 2.0).collect()
    assert [(s.first, s.last, s.lang) for s in r.spans] == [(0, 4, "en"), (5, 9, "de"), (10, 12, "el")]


def test_language_id_on_edge_rows(spark):
    docs = edge_docs(spark)
    by = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert by[None].held_out is None and by[1].lang_pred != "und"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).collect() == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(7, 3)).astype(np.float32)
    got = langid.viterbi(scores, np.array([0, 4]), np.array([4, 3]), 0.7)
    for a, n in ((0, 4), (4, 3)):
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = scores[np.arange(a, a + n), paths].sum(axis=1) - 0.7 * (np.diff(paths, axis=1) != 0).sum(axis=1)
        mine = got[a : a + n]
        assert np.isclose(scores[np.arange(a, a + n), mine].sum() - 0.7 * (np.diff(mine) != 0).sum(), value.max(), atol=1e-5)


def _insults(spark, n=1500):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = list(rng.choice(plain, 30)) + ([str(rng.choice(["idiot", "scumbag", "scumlike"]))] if bad else [])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = _insults(spark)
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 200 and right / len(rows) > 0.9
    kept = toxicity.clean(docs.withColumn("score", F.lit(1)), toxicity.fit(docs, labels))
    assert kept.columns == ["doc_id", "text", "score"] and 1100 < kept.count() < 1300


def test_toxicity_on_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_toxicity_sample_holds_one_row_of_each_doc_id(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("if(id < 19000, 1L, id) AS doc_id", "concat('word', id % 7, if(id % 2 = 0, ' vile', ' kind')) AS text")
    labels = spark.createDataFrame([(1, 1), (19_001, 1), (19_002, 0), (19_003, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "cut", lambda df: seen.append(df) or df)
    toxicity.fit(docs, labels, positives=10, unlabelled=40)
    assert seen[0].count() <= 50 and seen[0].groupBy("doc_id", "positive").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nnpu_risk_prefers_the_positive_feature(seed):
    rng = np.random.default_rng(seed)
    # As many rows as the operator's samples: with a few hundred, cells of the other five features hold too few to tell.
    x = (rng.random((6000, 6)) < 0.3).astype(np.float32)
    positive = np.arange(6000) < 2000
    x[positive, 0] = 1
    x[~positive, 0] = (rng.random(4000) < 0.1).astype(np.float32)
    theta = toxicity.train(x, positive, 0.1, seed)
    g = x @ theta[:-1] + theta[-1]
    assert (g[positive] > 0).mean() > 0.99 and (g[~positive & (x[:, 0] == 0)] < 0).mean() > 0.99


def test_url_rules_and_parts(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?y#z"), (2, "http://a.example.com/en/"), (3, "http://b.com"), (4, "https://x.net/es/1"),
        (5, "https://x.net?x=/es/"), (6, None), (7, "no host"), (8, "http://notexample.com/en/"), (9, "http://q.org/a://b"),
    ]
    pages = spark.createDataFrame([(*r, "h", "x", 1.0) for r in rows], "page_id long, url string, html string, rule string, score double")
    by = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert by[1].rule == "www.example.com/en/" and by[1].host == "www.example.com" and by[1].verdict == "allow"
    assert by[2].rule == "example.com/en/" and by[2].verdict == "block"
    assert by[3].rule is None and by[3].path == "" and by[4].rule == "net/es/"
    assert by[5].rule is None and by[5].host == "x.net" and by[6].host == by[7].path == ""
    assert by[8].rule == "com/" and by[9].path == "/a://b"
    assert all(r.verdict in ("allow", "block") for r in by.values())
    assert urlfilter.judge(pages.limit(0)).collect() == []


def test_url_models_part_what_they_have_seen(spark):
    rows = [(i, f"http://h{i}.{'com/good' if i % 2 else 'net/es/bad'}/{i}") for i in range(400)] + [(1000, "http://z.org/good/1"), (1001, "http://z.org/es/bad/1")]
    by = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert by[1000].rule is None and by[1000].verdict == "allow" and by[1001].verdict == "block"


_URLS = ["http://a.com/x", "http://a.com/y", "https://b.net/es/1?q=é", "http://a.com/x", "", "http://bb.com/xyz"]


def _seen(urls, share):
    """Counts of (context, byte) of each order by plain dictionaries, pruned as the model prunes them."""
    counts, total = Counter(), 0
    for url in urls:
        data = b"\x02" * urlfilter.ORDER + url.encode() + b"\x03"
        for at in range(urlfilter.ORDER, len(data)):
            total += 1
            for n in range(urlfilter.ORDER + 1):
                counts[data[at - n : at], data[at]] += 1
    of = Counter()
    for (context, _), n in counts.items():
        of[context] += n
    return {(c, b): n for (c, b), n in counts.items() if of[c] > 1 and of[c] * share >= total}


def _witten_bell(counts, context, byte):
    mine = {b: n for (c, b), n in counts.items() if c == context}
    shorter = _witten_bell(counts, context[1:], byte) if context else 1 / 256
    return (mine.get(byte, 0) + len(mine) * shorter) / (sum(mine.values()) + len(mine)) if mine else shorter


@pytest.mark.parametrize("share", [1 << 14, 12])
def test_url_counts_and_probabilities_equal_brute_force(spark, share):
    rows = [(u, k) for k in (False, True) for u in _URLS[k:]]
    found = urlfilter.counted(spark.createDataFrame(rows, "url string, accepted boolean").repartition(3), share).toPandas()
    for kind in (False, True):
        mine = found[found["accepted"] == kind]
        model = urlfilter.Markov(mine["key"].to_numpy(), mine["n"].to_numpy())
        counts = _seen(_URLS[kind:], share)
        assert sorted(mine["n"]) == sorted(counts.values())
        urls = [b"http://a.com/x", b"ftp://a.com", "ü".encode(), b""]
        got = urlfilter.log_likelihood([model], urls)[0]
        for url, one in zip(urls, got, strict=True):
            data = b"\x02" * urlfilter.ORDER + url + b"\x03"
            logs = [np.log(_witten_bell(counts, data[at - urlfilter.ORDER : at], data[at])) for at in range(urlfilter.ORDER, len(data))]
            assert one == pytest.approx(np.mean(logs))
        # After every context, seen or not, the probabilities of all bytes sum to one.
        keys = urlfilter.grams([u.encode() for u in _URLS] + [b"qqqqqqqqq"])[0][urlfilter.ORDER]
        for context in np.unique(keys >> 8).tolist():
            assert model.prob(np.arange(256) | context << 8).sum() == pytest.approx(1)


def test_url_models_without_evidence_tell_nothing():
    none = urlfilter.Markov(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert np.allclose(urlfilter.log_likelihood([none], [b"ab", b""]), np.log(1 / 256))


def test_url_parts_and_rules_equal_sql_on_all_pages(spark):
    sf = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
    sql = r"""
    WITH h AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM '{}/pages.parquet'),
         r AS (SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule),
         s AS (SELECT rule, split_part(rule, '/', 1) AS domain, substr(rule, strpos(rule, '/')) AS start FROM r)
    SELECT page_id, host, path, (SELECT arg_max(rule, len(rule)) FROM s
                                 WHERE ('.' || host) LIKE '%.' || domain AND starts_with(path, start)) AS rule
    FROM h
    """.format(sf)
    found = urlfilter.judge(spark.read.parquet(f"{sf}/pages.parquet")).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, duckdb.sql(sql).fetchall()))


def test_network_gradients_and_probabilities():
    rng = np.random.default_rng(0)
    params = [p.astype(np.float64) for p in pseudo_likelihood.initial()]
    around, target = rng.integers(0, pseudo_likelihood.CLASSES + 1, (40, 4)), rng.integers(0, pseudo_likelihood.CLASSES, 40)
    every = pseudo_likelihood.log_probs(params, np.repeat(around[:1], pseudo_likelihood.CLASSES, 0), np.arange(pseudo_likelihood.CLASSES))
    assert abs(np.exp(every).sum() - 1) < 1e-5
    for k, g in enumerate(pseudo_likelihood.gradients([p.astype(np.float32) for p in params], around, target)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        up, down = [p.copy() for p in params], [p.copy() for p in params]
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = -(pseudo_likelihood.log_probs(up, around, target).mean() - pseudo_likelihood.log_probs(down, around, target).mean()) / 2e-3
        assert slope == pytest.approx(g[at], rel=0.02, abs=1e-4)


def test_windows_stay_inside_the_text():
    edge = pseudo_likelihood.CLASSES
    got = pseudo_likelihood.windows(np.array([1, 2, 3, 9]), np.array([3, 0, 1]))
    assert got.tolist() == [[edge, edge, 2, 3], [edge, 1, 3, edge], [1, 2, edge, edge], [edge, edge, edge, edge]]


def test_pseudo_likelihood_prefers_what_follows_the_corpus(spark):
    rng = np.random.default_rng(4)
    lines = ["a b c d e f g h".split(), "p q r s t u v w".split()]
    rows = [(i, " ".join(lines[i % 2] * 12)) for i in range(300)] + [(1000, " ".join(rng.permutation("a b c d e f g h".split() * 12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = {r.doc_id: r["mean"] for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    assert by[0] > by[1000] + 0.5 and by[1] > by[1000]


def test_words_are_counted_over_all_documents(spark):
    """Classes and shares of every word of the blocks, against plain dictionaries; the most frequent words are classes of their own."""
    rng = np.random.default_rng(6)
    rare = [f"r{i}" for i in range(3000)]
    texts = [" ".join(["the"] * 3 + list(rng.choice(rare[: 50 + i * 40], 30))) for i in range(70)] + [None, "", "the \t żółć"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = Counter(w for t in texts if t for w in t.encode().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[: pseudo_likelihood.TOP]
    of = dict(zip(counts, pseudo_likelihood._class_of(list(counts), {w: i for i, w in enumerate(top)}).tolist(), strict=True))
    sums = Counter()
    for w, n in counts.items():
        sums[of[w]] += n
    seen = {}
    for r in pseudo_likelihood.encoded(docs).collect():
        own, known = pseudo_likelihood.unsqueezed(r.ids)
        (lens,), (classes,), (shares,) = (pseudo_likelihood.unsqueezed(x) for x in (r.lens, r["classes"], r.shares))
        ends = np.cumsum(lens)
        for i, n, end, share in zip(own.view(np.int64).tolist(), lens.tolist(), ends.tolist(), shares.view(np.float64).tolist(), strict=True):
            seen[i] = (classes[end - n : end].tolist(), share)
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert seen[i][0] == [of[w] for w in words]
        assert seen[i][1] == pytest.approx(sum(np.log(counts[w] / sums[of[w]]) for w in words), abs=1e-3)


def test_pseudo_likelihood_on_edge_rows(spark):
    docs = edge_docs(spark)
    by = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].log_likelihood == 0
    assert by[6].n_words == 20_000 and np.isfinite(by[6].log_likelihood)
    assert pseudo_likelihood.pseudo_likelihood(docs.limit(0)).collect() == []
