"""Plans of evidence against brute force, on tables made for them."""

import random

from tessera.operators import sequential
from tessera.plans import evidence


def _tables(spark, folder, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_quotes_of_every_length_are_found(spark, tmp_path):
    words = "The quick brown fox, über die Straße 漢字🙂 and on; " * 3
    texts = [words, "short", "xx" + words[5:90], "a" * 60, "", None, "zz the end", words[:24]]
    quotes = ["fox", "short", "", "a", "a" * 30, words[:24], words[3:27], words[4:44], "漢字🙂 and", "zz the end", "absent", None, "x" * 30, "🙂"]
    sf = _tables(
        spark, tmp_path,
        documents=(list(enumerate(texts)), "doc_id long, text string"),
        benchmark=([(f"q{i}", q) for i, q in enumerate(quotes)], "item_id string, text string"),
    )
    want = {(d, f"q{i}", t.find(q)) for d, t in enumerate(texts) for i, q in enumerate(quotes) if t is not None and q is not None and q in t}
    found = evidence.quote_grounding(spark, sf)
    assert sorted((r.doc_id, r.item_id, r.start_char) for r in found.collect()) == sorted(want)


def _greedy(rows, budget):
    """Brute force over ``(key, order, size)``."""
    left, taken = {}, []
    for key, at, size in sorted(rows):
        if key not in left or size <= left[key]:
            left[key] = left.get(key, budget) - size
            taken.append((key, at, size))
    return taken


def test_take_while_fits_prunes_exactly_what_a_budget_cannot_reach(spark, monkeypatch):
    draw = random.Random(1)
    rows = [("a", i, draw.choice([3, 7, 40, 90, 101, 250])) for i in range(900)]
    rows += [("b", i, 150 if i == 0 else 1) for i in range(50)] + [("c", i, 200 - i) for i in range(200)]
    rows += [("d", i, draw.randint(1, 60)) for i in range(300)]
    frame = spark.createDataFrame(rows, "key string, at long, size int").repartition(3)
    seen = []
    real = type(frame).groupBy
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *k: (seen.append(self), real(self, *k))[1])
    found = sequential.take_while_fits(frame, ["key"], ["at"], "size", 100)
    assert sorted(map(tuple, found.collect())) == _greedy(rows, 100)
    # Groups meet only rows within reach: of 900 rows of the first key, those of 6 sizes.
    assert seen[-1].filter("key = 'a'").count() <= 33 + 14 + 2 + 1 + 1


def test_budget_round_robin_equals_brute_force(spark, tmp_path):
    draw = random.Random(2)
    docs = [(i, "\n".join("w" * draw.choice([0, 5, 400, 3000, 25_000]) for _ in range(draw.randint(1, 8))), f"s{i % 3}") for i in range(60)]
    sf = _tables(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"))
    rows = []
    for doc_id, text, source in docs:
        lines = [(pos, len(line)) for pos, line in enumerate(text.split("\n")) if line]
        rows += [(source, (i + 1, doc_id, pos), n) for i, (pos, n) in enumerate(lines)]
    found = evidence.budget_round_robin(spark, sf).collect()
    assert sorted((r.source, (r.round, r.doc_id, r.pos), r.chars) for r in found) == _greedy(rows, 20_000)
