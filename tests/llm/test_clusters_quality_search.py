"""Clusters over approximated vectors, adaptive quality fences, and ranked search: brute force, SQL twins and edge rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import k2treap, lexical, quality, vafile

from .common import edge_docs


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_arrow", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, sorted(map(repr, found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()))


def _same(df, sql, **tables):
    columns, want = _sql(sql, **tables)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


VECTORS = "vec_id long, embedding array<double>, cluster int, distance long, ids binary"


def _vectors(spark, n, seed=1, scale=0.1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, scale, 64).tolist(), 7, 7, b"x") for i in range(n)]
    rows += [(5, rows[5 % n][1], 7, 7, None), (5, rows[0][1], 7, 7, None), (None, rows[1][1], 7, 7, None)] if n else []
    bad = [1.0] * 63
    rows += [(9000, None, 7, 7, None), (9001, bad, 7, 7, None), (9002, [*bad, None], 7, 7, None), (9003, [*bad, math.nan], 7, 7, None), (9004, [*bad, -math.inf], 7, 7, None), (9005, [*bad, 1e300], 7, 7, None), (9006, [], 7, 7, None), (9007, [*bad, 1.0, 1.0], 7, 7, None)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


@pytest.mark.parametrize("n", [300, 12, 0])
def test_clusters_against_sql_on_edge_rows(spark, n):
    vectors = _vectors(spark, n)
    found = vafile.clusters(vectors)
    assert found.count() == (n + 3 if n else 0)
    _same(found, vafile.ORACLE, embeddings=vectors)


def test_large_components_and_hot_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(2**18 * x) for x in rng.normal(0, 0.3, 64)] if i % 3 else [0.25] * 64) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    _same(vafile.clusters(vectors), vafile.ORACLE, embeddings=vectors)


def test_cells_decide_where_clusters_are_apart():
    rng = np.random.default_rng(3)
    centre = rng.integers(-200, 200, (8, 64))
    x = centre[rng.integers(0, 8, 2000)] + rng.integers(-10, 11, (2000, 64))
    borders = np.stack([np.quantile(x[:, j], np.arange(1, 64) / 64).astype(np.int64) for j in range(64)])
    tables = vafile.lookup(centre, borders, x.min(axis=0), x.max(axis=0))
    cells = np.stack([np.searchsorted(borders[j], x[:, j], side="right") for j in range(64)], 1)
    distance = ((x[:, None] - centre[None]) ** 2).sum(axis=2)
    low, high = (sum(tables[j][cells[:, j]] for j in range(64))[:, part] for part in (slice(0, 8), slice(8, 16)))
    assert (low <= distance).all() and (distance <= high).all()
    best, fetched = vafile.nearest(cells, x, centre, tables)
    assert (best == distance.argmin(axis=1)).all() and fetched < 20


def test_packed_cells_come_back():
    cells = np.random.default_rng(1).integers(0, 64, (500, 64)).astype(np.uint8)
    packed = np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 2:]).tobytes()
    assert len(packed) == 500 * 48 and (vafile.unpacked(packed) == cells).all()


def _quality_docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        lang, source = ("en", "web") if i % 3 else rng.choice([("de", "a"), ("de", "b"), ("fr", None), (None, "c"), (None, None)])
        words = [rng.choice("abcdefghij") * rng.randint(2, 7 if lang == "en" else 12) for _ in range(rng.choice([3, 49, 50, 120]))]
        kind = rng.random()
        if kind < 0.05:
            words = ["#$%" if rng.random() < 0.6 else w for w in words]
        elif kind < 0.1:
            words = words[:20] * 6
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words) + ("\nsame line\n" * 3 if kind > 0.9 else ""), lang, source, 0, 0.5, True, 1, 2, 3))
    return spark.createDataFrame(rows, edge_docs(spark).schema)


def test_quality_against_sql(spark):
    docs = _quality_docs(spark).unionByName(edge_docs(spark)).repartition(3)
    found = quality.judged(docs).cache()
    assert found.count() == docs.count()
    _same(found, quality.ORACLE, documents=docs)
    assert 0 < found.filter("NOT base_failed AND NOT kept").count() < found.filter("kept").count()


def test_base_counts_one_by_one(spark):
    texts = {1: "a b c a b c", 2: "a b c d", 3: "x\nx\n \nx y\n\nx", 4: "a a a a a", 5: "é#& <b>|*", 6: None, 7: "\t\n", 8: "a b c x a b c y a b"}
    docs = spark.createDataFrame([(i, t, None, None) for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base(docs).collect()}
    assert got == {1: (6, 6, 0, 0, 6), 2: (4, 4, 0, 0, 0), 3: (5, 5, 0, 2, 0), 4: (5, 5, 0, 0, 5), 5: (2, 8, 6, 0, 0), 6: (0, 0, 0, 0, 0), 7: (0, 0, 0, 0, 0), 8: (10, 10, 0, 0, 6)}


def test_fences_are_each_groups_own_and_sketches_merge(spark):
    rows = [(f"k{g}", f"s{g}", g * 400 + i % 40, 0, 0, 0) for g in (1, 2) for i in range(200)] + [("k3", "s1", 9000, 0, 0, 0)]
    passed = spark.createDataFrame(rows, "key string, tongue string, chars long, symbols long, dup_lines long, repeats long")
    found = {r.key: r for r in quality.fences(passed).collect()}
    assert found["k1"].high_chars < found["k2"].low_chars
    assert found["k3"].high_chars == found["k1"].high_chars  # one document: judged by its language
    parts = [quality.sketch(passed.filter(f"chars % 2 = {i}"), ["key"]) for i in (0, 1)]
    whole = sorted(map(tuple, quality.sketch(passed, ["key"]).collect()))
    assert sorted(map(tuple, quality.merged(parts[0].unionByName(parts[1]), ["key"]).collect())) == whole


def test_quality_plan_has_no_python_and_an_empty_table_no_rows(spark):
    docs = edge_docs(spark)
    for part in (quality.base(docs), quality.judged(docs)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))
    assert quality.judged(docs.limit(0)).collect() == []


@pytest.mark.parametrize("beam", [1, 7, 256])
def test_descent_against_all_sums(beam, monkeypatch):
    monkeypatch.setattr(k2treap, "BEAM", beam)
    rng = np.random.default_rng(beam)
    for rows, columns, most in ((1, 1, 9), (40, 300, 3), (300, 30, 1000), (64, 64, 1)):
        grid = np.where(rng.random((rows, columns)) < 0.2, rng.integers(0, most + 1, (rows, columns)), -1)
        r, c = np.nonzero(grid >= 0)
        if not len(r):
            continue
        tree = k2treap.load(k2treap.build(r, c, grid[r, c]))
        asked = [(i, x, int(rng.integers(1, 5))) for i in (0, 3, 4) for x in sorted(rng.choice(rows, min(rows, 6), replace=False).tolist())]
        item, row, weight = (np.array(x, np.int64) for x in zip(*asked, strict=True))
        got = list(zip(*(x.tolist() for x in k2treap.search(tree, item, row, weight, 5)), strict=True))
        want = []
        for i in (0, 3, 4):
            sums = sum(w * np.maximum(grid[x], 0) for j, x, w in asked if j == i)
            order = np.lexsort((np.arange(columns), -sums))[:5]
            want += [(i, int(j), int(sums[j])) for j in order if sums[j] > 0]
        assert got == want


def test_search_against_sql_over_many_shards(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["the", "of", "Zeta", "été", "naïve", "x1", "42"] + [f"w{i}" for i in range(200)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary[: rng.choice([7, 207])]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(300)]
    rows += [(1000 + i, "the the x1 w7") for i in range(150)]  # a third of all documents are copies, which tie
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs(spark).filter("doc_id IS NOT NULL AND doc_id <> 2").select(spark_id(), "text"))
    items = spark.createDataFrame([(i, text(12), 1) for i in range(30)] + [(99, "the w7 x1 the", 1), (100, None, 1), (101, " .,", 1), (102, "nowhere", 1), (None, "w7 w7", 1)], "item_id long, text string, score long")
    monkeypatch.setattr(lexical, "SHARD", 3000)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    found = lexical.search(docs.repartition(3), items.repartition(2)).cache()
    _same(found, lexical.ORACLE, documents=docs, benchmark=items)
    copies = [r.doc_id for r in found.filter("item_id = 99 AND doc_id BETWEEN 1000 AND 1999").orderBy("rank").collect()]
    assert copies and copies == list(range(1000, 1000 + len(copies)))


def spark_id():
    from pyspark.sql import functions as F

    return (F.col("doc_id") + 5000).alias("doc_id")


def test_search_on_edge_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "ALPHA beta"), (1, "alpha"), (2, "ñandú 42")], "item_id long, text string")
    rows = lexical.search(docs, items).collect()
    # Doc 2 comes twice, the document without an id after all others; items of one id each have their ranks.
    ranks = [[(r.rank, r.doc_id) for r in rows if r.item_id == 1 and r.rank == k] for k in (1, 2, 3, 4)]
    assert ranks == [[(1, 1)] * 2, [(2, 2)] * 2, [(3, 2)] * 2, [(4, None)] * 2]
    assert [r.doc_id for r in rows if r.item_id == 2] == [9]
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
