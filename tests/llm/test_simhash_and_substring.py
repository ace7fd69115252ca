import random

import numpy as np
import pytest
import xxhash

from tessera.llm import recompression, simhash, substring_dedup
from tessera.llm.components import components

from .common import edge_docs


def test_fingerprint_by_hand():
    words = "Ab cD ef gh ij".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if all(h >> b & 1 for h in hashes))
    assert simhash.fingerprint(b"Ab cD\tef\n gh ij") == want
    assert simhash.fingerprint(b"One") == xxhash.xxh64_intdigest("one", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint("É".encode()) == xxhash.xxh64_intdigest("É", 42)  # only A-Z are lower-cased


def test_near_dups_on_edge_rows(spark):
    docs = edge_docs(spark)
    rows = simhash.near_dups(docs).collect()
    assert len(rows) == docs.count()
    want = simhash.brute_force(docs.filter("doc_id IS NOT NULL").toPandas())
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert next(r.component_id for r in rows if r.doc_id is None) == 1
    assert all(len(r.fingerprint) == 16 for r in rows)
    assert simhash.near_dups(docs.limit(0)).collect() == []


@pytest.mark.parametrize("clusters,n,spread,leaf", [(1, 1500, 6, 256), (1, 1500, 6, 4), (5, 3000, 9, 256), (40, 2000, 4, 8)])
def test_index_loses_no_link(spark, monkeypatch, clusters, n, spread, leaf):
    """Dense clusters, many of them in one top node and over several leaves and levels of upper nodes; nodes' links in parts."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, clusters, dtype=np.uint64)
    found = set()
    for k in range(n):
        v = int(centres[k % clusters])
        for bit in rng.integers(0, 64, rng.integers(0, spread)):
            v ^= 1 << int(bit)
        found.add(v)
    fp = np.array(sorted(found), np.uint64).view(np.int64)
    rows = spark.createDataFrame([(int(v),) for v in fp], "fp long").repartition(4)
    links = simhash.links(rows, 4)
    got = {r.node: r.component for r in components(links).collect()}
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= 4
    root = fp.copy()
    while True:
        new = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        if np.array_equal(new, root):
            break
        root = new
    assert all(got.get(int(v), int(v)) == int(r) for v, r in zip(fp, root, strict=True))


@pytest.mark.parametrize("n", [10, 10**6, 10**9])
def test_masks_cover_every_pattern_of_differences(n):
    tops = simhash.masks(n, 4)
    rng = random.Random(n)
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in tops)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40))


def _texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(40, 160))) for _ in range(4)]
    for i in range(250):
        k = rng.random()
        if k < 0.3:
            t = rng.choice(base)
        elif k < 0.6:
            x = rng.choice(base).split()
            a = rng.randrange(len(x))
            t = " ".join([rng.choice("xyz") for _ in range(rng.randint(0, 60))] + x[a : a + rng.randint(20, 100)] + [rng.choice("xyz") for _ in range(rng.randint(0, 60))])
        elif k < 0.8:
            t = " ".join([rng.choice("ab")] * rng.randint(30, 90) + [rng.choice("ab")] * rng.randint(0, 90))
        else:
            t = " ".join(["a", "b", "c"][: rng.randint(1, 3)] * rng.randint(10, 60))
        yield i, t


@pytest.mark.parametrize("hot", [20, 1000])
def test_substring_dedup_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = [*_texts(), (1000, None), (1001, ""), (1002, "a  b\tc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = substring_dedup.brute_force(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect()}
    assert got == want


def test_substring_dedup_on_edge_rows(spark):
    docs = edge_docs(spark)
    rows = substring_dedup.dedup(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].n_removed == 20_000 and by[7].kept == "" and by[6].n_removed == 0
    assert by[3].n_words == 0 and by[None].n_removed == 0
    assert substring_dedup.dedup(docs.limit(0)).collect() == []


def test_equal_windows_have_equal_witnesses():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    inner = words[rng.integers(0, 12, 80)]
    seen = set()
    for _ in range(20):
        left, right = (words[rng.integers(0, 12, rng.integers(0, 30))] for _ in range(2))
        text = np.concatenate([left, inner, right])
        at, found = recompression.witnesses(text, np.array([len(text)]), 50)
        seen.add(tuple(found[np.searchsorted(at, np.arange(len(left), len(left) + 31))].tolist()))
        assert len(at) == len(text) - 49
    assert len(seen) == 1


@pytest.mark.parametrize("hot", [1, 1000])
def test_texts_of_one_doc_id_lose_only_their_own_windows(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, f"{c} {b}"), (4, b), (4, None), (4, c), (5, f"{a} z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (2, 60, 0), (2, 60, 60), (3, 120, 60), (4, 0, 0), (4, 60, 60), (4, 60, 60), (5, 61, 60)]
