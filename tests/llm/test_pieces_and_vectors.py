import numpy as np
import pytest
import sentencepiece

from tessera.llm import ann, hnsw
from tessera.llm import sentencepiece_lattice as sl

from .common import edge_docs, on_disk


def test_encoding_equals_the_library_and_decodes_back(spark, tmp_path):
    texts = ["the quick brown fox", "  two  spaces ", "naïve Straße\n\ttab", "漢字🙂x", "a" * 100, "Zażółć gęślą jaźń", "x▁y", "漢 字 ж ю 🙂 ☃ x"]
    docs = on_disk(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=sl.MODEL)
    encoded = sl.encode(docs)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sl.decode(encoded).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_long_runs_without_spaces_equal_the_library(spark, tmp_path):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    texts = ["x" * 5000, "".join(rng.choice(letters, 6000)), "the" * 1500, "die Straße " + "zusammengesetzt" * 300 + " und", " " * 700 + "a" + "-" * 900 + " " * 300,
             "".join(rng.choice(list("漢字かなカナ、。中文数据"), 3000)), "http://example.com/" + "path/to/page?q=1&" * 200, "ß" * 129 + "\n" + "é漢" * 400]
    docs = on_disk(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path)
    library = sentencepiece.SentencePieceProcessor(model_file=sl.MODEL)
    got = {r.doc_id: list(r.ids) for r in sl.encode(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t), i


def test_long_units_by_both_kinds_equal_the_folds(spark):
    pieces = sl.load()
    table = {p: (s, i) for i, p, s in pieces.rows}
    words = ["▁" + "worthless" * 4, "aaaaaaaaaaaaab", "▁▁Enpaeux漢", "internationalization"]
    frame = spark.createDataFrame([(0, w) for w in words], "k long, unit string")
    merged = {r.unit: list(r.ids) for r in sl.merged_paths(sl.lattice(frame, pieces, 2)).collect()}
    best = {r.unit: list(r.ids) for r in sl.best_paths(sl.lattice(frame, pieces)).collect()}
    for w in words:
        assert sl.merged_path(w, table) == merged[w]
        assert sl.best_path(w, table, pieces.longest, pieces.unknown) == best[w]


def _all_paths(unit, table, unknown, longest):
    """Every segmentation of a short unit: its sum of scores and ids."""
    if not unit:
        return [(0.0, [])]
    out = []
    for n in range(1, min(longest, len(unit)) + 1):
        found = table.get(unit[:n]) or ((unknown, -ord(unit[0])) if n == 1 else None)
        if found:
            out += [(found[0] + s, [found[1], *ids]) for s, ids in _all_paths(unit[n:], table, unknown, longest)]
    return out


def test_viterbi_fold_finds_the_best_sum(spark):
    """Unigram reading: against every segmentation; where several have the best sum, any of them is right."""
    even = sl.Pieces([(3, "a", -1.0), (4, "b", -1.0), (5, "ab", -1.5), (6, "ba", -1.5)], [], [0] * 256, -9.0, "")
    cases = [(sl.load(), ["▁the", "▁Enpaeux", "▁schlich", "tionment", "▁zürich", "worthless", "漢字x", "aaaaaaaa", "▁"]), (even, ["aba", "babab", "abxba"])]
    tied = []
    for pieces, words in cases:
        table = {p: (s, i) for i, p, s in pieces.rows}
        units = spark.createDataFrame([(0, w) for w in words], "k long, unit string")
        got = {r.unit: list(r.ids) for r in sl.best_paths(sl.lattice(units, pieces)).collect()}
        for w in words:
            paths = _all_paths(w, table, pieces.unknown, pieces.longest)
            best = max(s for s, _ in paths)
            right = [ids for s, ids in paths if s == best]
            assert got[w] in right
            tied += [w] * (len(right) > 1)
    assert {"aba", "babab"} <= set(tied)


def test_branches_share_one_exchange(spark, tmp_path):
    docs = on_disk(spark, edge_docs(spark), tmp_path)
    encoded = sl.encode(docs)
    encoded.collect()
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and final.count("ReusedExchange") == 2, final


def test_encoding_of_edge_rows(spark, tmp_path):
    docs = on_disk(spark, edge_docs(spark), tmp_path)
    rows = sl.encode(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and list(by[3].ids) == list(by[4].ids) == []
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in sl.decode(sl.encode(docs)).collect():
        assert r.text == (text[r.doc_id] or "")
    assert sl.encode(docs.limit(0)).collect() == []


def test_units_are_not_crossed_by_pieces():
    pieces = sl.load()
    pattern = sl.unit_pattern(pieces)
    found = sl.units("a  bc\nd ", pattern)
    assert found == ["▁a", "▁▁bc", "\n", "d", "▁"]
    assert sl.units("", pattern) == []


def _unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_hnsw_recall():
    rng = np.random.default_rng(0)
    x = _unit(rng.normal(size=(3000, 24)))
    level, graph = hnsw.build(x)
    assert graph[0].shape == (3000, 2 * hnsw.M) and (graph[0] >= 0).any(axis=1).all()
    near = hnsw.search(x, level, graph, x[:200])[:, :10]
    exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near.tolist(), exact.tolist(), strict=True)]) > 0.9


def test_neighbours_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 700)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[500:1000] = x[500]  # one vector a quarter of the rows share
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = ann.neighbours(rows, every=50, k=5).collect()
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        s = np.round(wide @ wide[q], 9)
        s[q] = -9
        best = np.lexsort((np.arange(2000), -s))[:5]
        hits += len(set(best.tolist()) & {v for _, v, _ in mine})
        assert all(abs(score - float(wide[v] @ wide[q])) < 1e-9 for _, v, score in mine)
    assert hits / (40 * 5) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.5, 0.5]),
        (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (100, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 0.0, 0) for r in rows], "vec_id long, embedding array<double>, rank int, score double, shard int")
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.neighbours(df, every=50, k=5).collect())
    assert found == [(0, 1, 3), (0, 2, 100), (0, 3, 4), (100, 1, 0), (100, 2, 3), (100, 3, 4)]
    assert ann.neighbours(df.limit(0), every=50, k=5).collect() == []


def test_vectors_whose_squares_leave_the_double_range(spark):
    rows = [(0, [1e200, 1.0]), (1, [1.0, 0.1]), (2, [1e-200, 1e-200]), (3, [3e300, -3e299]), (4, [0.0, 5e-324])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect()
    got = [(r.vec_id, round(r.score, 9)) for r in sorted(found, key=lambda r: r["rank"])]
    assert got == [(1, round(1 / 1.01**0.5, 9)), (3, round(1 / 1.01**0.5, 9)), (2, round(0.5**0.5, 9)), (4, 0.0)]
