"""Steps that depend on the steps before: against folds written out one by one, and their edge cases."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import allocation, claims, graph, inheritance, rebasing, releases, rounds
from tessera.plans import catalog
from tessera.streaming import effects

# ---- allocation ----

ITEMS = f"run string, seq long, task long, choices {allocation.CHOICES}, note string"


def _walk(items, sources, searches):
    """What a loop over each run's items would grant."""
    out = {}
    for run in {i[0] for i in items}:
        ids, tasks, counted = set(), set(), 0
        for _, seq, task, choices, _ in sorted((i for i in items if i[0] == run), key=lambda i: i[1]):
            answer = (None, [])
            for action, kind, pool in choices or []:
                pool = list(dict.fromkeys(x for x in pool or [] if x is not None))
                if kind == "pool":
                    had = []
                    for x in pool:
                        if x in ids or len(ids) < sources:
                            ids.add(x)
                            had.append(x)
                    if had:
                        answer = (action, had)
                        break
                elif kind == "always":
                    answer = (action, [])
                    break
                elif kind == "forced":
                    tasks.add(task)
                    counted += 1
                    answer = (action, [])
                    break
                elif task in tasks or counted < searches:
                    counted += task not in tasks
                    tasks.add(task)
                    answer = (action, [])
                    break
            out[run, seq] = answer
    return out


def _items(seed):
    rng = random.Random(seed)
    kinds = [("known", "pool"), ("retry", "pool"), ("search", "search"), ("review", "always"), ("scope", "forced")]
    items = []
    for seq in range(500):
        run = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c"])
        chosen = rng.sample(kinds[:4], rng.randint(0, 4)) if rng.random() < (0.95 if seed % 2 else 0.6) else [kinds[4], kinds[3]]
        choices = [(a, k, [rng.choice([None, *range(30)]) for _ in range(rng.randint(0, 3))] if k == "pool" else []) for a, k in chosen]
        items.append((run, seq, rng.randint(1, 12), choices if rng.random() < 0.97 else None, "x"))
    return items


@pytest.mark.parametrize("seed,sources,searches", [(1, 6, 3), (2, 0, 2), (3, 4, 0), (4, 100, 100), (5, 1, 1), (6, 0, 0), (8, 5, 9), (10, 3, 12)])
def test_allocation_equals_the_walk(spark, seed, sources, searches):
    items = _items(seed)
    got = allocation.allocate(spark.createDataFrame(items, ITEMS).repartition(5), sources, searches).collect()
    assert {(r.run, r.seq): (r.action, r.ids) for r in got} == _walk(items, sources, searches) and len(got) == len(items)
    assert allocation.allocate(spark.createDataFrame([], ITEMS), sources, searches).collect() == []


def test_only_items_that_budgets_can_reach_are_folded(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("run"), F.col("id").alias("seq"), (F.col("id") % 40).alias("task"))
    pool, search = allocation.choice("known", "pool", F.array(F.col("seq") % 1000)), allocation.choice("search", "search")
    items = rows.withColumn("choices", F.when(F.col("seq") % 2 == 0, F.array(pool, search)).otherwise(F.array(search, pool)))
    left = allocation.deciding(items, 12, 4).collect()
    assert 0 < len(left) <= 24 and max(r.seq for r in left) < 24


def test_a_run_is_folded_in_one_task_whatever_joins_came_before(spark):
    pool, search = allocation.choice("known", "pool", F.array(F.col("seq") % 97, F.col("seq") % 31)), allocation.choice("search", "search")
    rows = spark.range(0, 40_000, numPartitions=8).select((F.col("id") * 7 % 40).cast("string").alias("run"), F.col("id").alias("seq"), (F.col("id") % 13).alias("task"))
    folded = allocation.deciding(rows.withColumn("choices", F.when(F.col("seq") % 3 == 0, F.array(pool, search)).otherwise(F.array(search, pool))), 12, 4)
    found = allocation.grants(folded.hint("shuffle_hash").join(spark.range(40).select(F.col("id").cast("string").alias("run")), "run"), 12, 4)
    assert "hashpartitioning(xxhash64(run" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.run, r.kind): r.n for r in found.groupBy("run", "kind").agg(F.count("*").alias("n")).collect()} == {(str(i), k): n for i in range(40) for k, n in (("pool", 12), ("search", 4))}


def test_a_task_forced_past_the_budget_is_searched_at_no_cost(spark):
    forced, late = [("scope", "forced", [])], [("search", "search", []), ("retry", "pool", [7])]
    items = [("a", n, task, forced, "x") for n, task in enumerate((1, 1, 1, 2))] + [("a", 4, 2, late, "x"), ("a", 5, 9, [("known", "pool", [8, 9])], "x")]
    got = allocation.allocate(spark.createDataFrame(items, ITEMS), 2, 3).collect()
    assert {(r.run, r.seq): (r.action, r.ids) for r in got} == _walk(items, 2, 3)


# ---- graphs ----


def test_closure_cycles_and_depths(spark):
    rng = random.Random(3)
    edges = {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(45)} | {(100 + i, 101 + i) for i in range(12)} | {(7, 7)}
    frame = spark.createDataFrame([*edges, (None, 1), (1, None), *list(edges)[:5]], "node long, needs long")
    reach = set(edges)
    while more := {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c} - reach:
        reach |= more
    assert {tuple(r) for r in graph.closure(frame).collect()} == reach
    nodes = {x for e in edges for x in e} | {500}
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame([(n,) for n in nodes] + [(None,)], "node long"), frame).collect()}
    needs = {n: {b for a, b in edges if a == n} for n in nodes}

    def depth(n):
        below = {b for a, b in reach if a == n} | {n}
        return None if any((b, b) in reach for b in below) else max((depth(b) + 1 for b in needs[n]), default=0)

    assert got == {n: depth(n) for n in nodes}
    assert graph.closure(frame.limit(0)).collect() == []


def _counted(monkeypatch):
    rows, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rows.append((df := write(df, name)).count()) or df)
    return rows


def test_rounds_of_a_closure_double_its_reach(spark, monkeypatch):
    rows = _counted(monkeypatch)
    ring = {(200 + i, 200 + (i + 1) % 5) for i in range(5)}
    frame = spark.createDataFrame([*((i, i + 1) for i in range(40)), *ring, (40, 200)], "node long, needs long")
    found = {tuple(r) for r in graph.closure(frame).collect()}
    ends = set(range(200, 205))
    assert found == {(i, j) for i in range(41) for j in range(i + 1, 41)} | {(i, j) for i in [*range(41), *ends] for j in ends}
    assert len(rows) <= 16


def test_tasks_reach_questions_once(spark, monkeypatch, tmp_path):
    rows = _counted(monkeypatch)
    spark.range(1, 4001).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("p_brand")).write.parquet(str(tmp_path / "part.parquet"))
    found = {r.task: (r.questions, r.depends_on) for r in catalog.QUERIES["plan_dependencies"](spark, str(tmp_path)).collect()}
    assert found == {"a": (2000, "b"), "b": (2000, "a")}
    assert sum(rows) < 20_000 < graph.closure(spark.range(2, 4001).selectExpr("id AS node", "id div 2 AS needs")).count()


def test_labels_reach_what_their_nodes_lead_to(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (None, 1), (6, None)], "node long, needs long")
    starts = spark.createDataFrame([("x", 2), ("x", 2), ("y", 4), ("z", 5), ("z", 9), (None, 1), ("n", None)], "label string, node long")
    assert sorted(map(tuple, graph.reached(starts, edges).collect())) == [("x", 1), ("x", 2), ("x", 3), ("y", 1), ("y", 2), ("y", 3), ("y", 4), ("z", 5), ("z", 6), ("z", 9)]
    assert graph.reached(starts.limit(0), edges).collect() == []


def test_a_chain_that_comes_back_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))
    rows = graph.ancestors(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node long, parent long")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0)]


# ---- inheritance ----

PROFILES = "profile string, parent string, availability string, reset boolean, depth int"
QUESTIONS = "question string, min_depth int, fields array<string>, requirement int, min_sources int, source_types array<string>, max_age int"
RULES = (
    "profile string, question string, pos long, op string, availability string, all_fields boolean, field string, field_availability string, drop_field string, "
    "requirement int, min_sources int, source_type string, max_age int, clear_age boolean, catalog_evidence boolean"
)


def _rule(profile, question, pos, op="rule", **sets):
    names = [x.split()[0] for x in RULES.split(", ")][4:]
    return (profile, question, pos, op, *[sets.get(n) for n in names])


def _asked(spark, profiles, rules):
    questions = [("fees", 1, ["amount", "currency"], 2, 1, ["registry"], 365), ("staff", 2, ["count"], 1, 2, ["site"], None), ("risk", 3, ["note"], 3, 1, [], 30)]
    frames = spark.createDataFrame(profiles, PROFILES), spark.createDataFrame(rules, RULES), spark.createDataFrame(questions, QUESTIONS)
    asked = inheritance.materialised(*frames)
    return {(r.profile, r.question): r for r in asked.collect()}, {r.profile: r.sha256 for r in inheritance.snapshots(asked).collect()}


def test_rules_fold_down_three_levels(spark):
    profiles = [("L1", None, "public", False, None), ("L2", "L1", "gated", True, 2), ("L3", "L2", "private", False, None), ("other", None, "public", False, 1)]
    rules = [
        _rule("L1", "fees", 1, all_fields=True, min_sources=3, max_age=90, source_type="press"),
        _rule("L1", "fees", 2, drop_field="currency", requirement=1),
        _rule("L1", "risk", 3, field="note", field_availability="manual"),
        _rule("L2", "fees", 1, field="vat", field_availability="gated", clear_age=True),
        _rule("L3", "risk", 1, "exclude"),
        _rule("L3", "fees", 2, all_fields=True, field="amount", field_availability="private", catalog_evidence=True),
        _rule("L3", "staff", 3, min_sources=9),
    ]
    got, first = _asked(spark, profiles, rules)
    fields = lambda p, q: [tuple(x) for x in got[p, q].fields]
    assert fields("L1", "fees") == [("amount", "public")] and got["L1", "fees"].requirement == 1
    # The reset takes the stricter of both; the rule after it lifts the age. What was excluded is not filled in again.
    assert fields("L2", "fees") == [("amount", "public"), ("vat", "gated")]
    two = got["L2", "fees"]
    assert (two.requirement, two.min_sources, two.source_types, two.max_age) == (2, 3, ["registry", "press"], None)
    assert fields("L3", "fees") == [("amount", "private"), ("vat", "gated")]
    three = got["L3", "fees"]
    assert (three.min_sources, three.source_types, three.max_age) == (1, ["registry"], 365)
    assert fields("L2", "staff") == [("count", "gated")] and got["L3", "staff"].min_sources == 9
    assert ("L3", "risk") not in got and got["L2", "risk"].max_age == 30 and ("other", "fees") in got
    # A rule of the root changes the hash of all below, and of nothing else.
    _, second = _asked(spark, profiles, [*rules[:-1], _rule("L3", "staff", 3, min_sources=9), _rule("L1", "fees", 9, min_sources=4)])
    assert {p for p in first if first[p] != second[p]} == {"L1", "L2"}  # the child takes the catalog's evidence
    _, third = _asked(spark, profiles, [*rules, _rule("L1", "fees", 9, drop_field="amount")])
    assert {p for p in first if first[p] != third[p]} == {"L1", "L2", "L3"}


def test_a_question_comes_back_after_it_was_excluded(spark):
    profiles = [("a", None, "public", False, None), ("b", "a", "gated", False, None), ("c", "b", "gated", True, None)]
    rules = [_rule("a", "fees", 1, all_fields=True, requirement=4), _rule("b", "fees", 1, "exclude"), _rule("c", "fees", 1, field="vat", field_availability="public")]
    got, _ = _asked(spark, profiles, rules)
    assert ("b", "fees") not in got and [tuple(x) for x in got["c", "fees"].fields] == [("vat", "public")] and got["c", "fees"].requirement == 2


def test_pairs_that_only_depths_touch_are_not_exchanged(spark):
    profiles = spark.range(1, 201).selectExpr("cast(id AS string) AS profile", "cast(nullif(id div 4, 0) AS string) AS parent", "concat('a', id % 3) AS availability", "id % 5 = 0 AS reset", "cast(CASE WHEN id % 6 = 1 THEN 2 END AS int) AS depth")
    questions = spark.range(2000).selectExpr("cast(id AS string) AS question", "cast(1 + id % 3 AS int) AS min_depth", "array('x', 'y') AS fields", "1 AS requirement", "2 AS min_sources", "array('s', 's') AS source_types", "3 AS max_age")
    rules = spark.createDataFrame([_rule("1", "3", 1, field="z", field_availability="m"), _rule("7", "4", 1, "exclude")], RULES)
    asked = inheritance.materialised(profiles, rules, questions)
    found = {(int(r.profile), int(r.question)): r for r in asked.collect()}
    up = lambda p: [p] + (up(p // 4) if p // 4 else [])
    reached = {p for p in range(1, 201) if any(a % 6 == 1 for a in up(p))}
    under = {p for p in range(1, 201) if 7 in up(p)}
    expected = {(p, q) for p in reached for q in range(2000) if q % 3 < 2} | {(p, 3) for p in range(1, 201) if 1 in up(p)}
    # An exclusion takes the question from the profile itself and all that a deeper depth does not give it back.
    back = {p for p in under if any(a % 6 == 1 for a in up(p)[: up(p).index(7)])}
    assert set(found) == expected - {(p, 4) for p in under - back}
    for (p, q), r in found.items():
        if q not in (3, 4):
            first = next(a for a in reversed(up(p)) if a % 6 == 1)
            later = any(a % 5 == 0 for a in up(p)[: up(p).index(first)])
            assert [tuple(f) for f in r.fields] == [("x", f"a{first % 3}"), ("y", f"a{first % 3}")] and r.source_types == (["s"] if later else ["s", "s"])
    # Rows that are exchanged or written are rules and lists of a profile or block, far fewer than the pairs.
    assert inheritance._ruled(*inheritance._chains(profiles), rules, questions).count() < 1000 < len(found)


def test_hashes_of_pairs_that_only_depths_touch_are_not_exchanged(spark):
    profiles = spark.range(1, 201).selectExpr("cast(id AS string) AS profile", "cast(nullif(id div 4, 0) AS string) AS parent", "concat('a', id % 3) AS availability", "id % 5 = 0 AS reset", "cast(CASE WHEN id % 6 = 1 THEN 1 + id % 2 END AS int) AS depth")
    questions = spark.range(600).selectExpr("cast(id AS string) AS question", "cast(1 + id % 3 AS int) AS min_depth", "array('x', 'y') AS fields", "cast(id % 4 AS int) AS requirement", "2 AS min_sources", "array('s', 's') AS source_types", "3 AS max_age")
    rules = [_rule("2", "3", 1, field="z", field_availability="m"), _rule("7", "4", 1, "exclude"), _rule("200", "5", 1, all_fields=True), _rule("3", "none", 1, all_fields=True)]
    frames = profiles, spark.createDataFrame(rules, RULES), questions.unionByName(questions.filter("question IN (3, 6)").withColumn("max_age", F.lit(9)))
    expected = inheritance.snapshots(inheritance.materialised(*frames)).collect()
    made = inheritance.profile_snapshots(*frames)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, expected)) and sum(r.questions for r in expected) > 10_000


# ---- merged runs ----

CLAIMS = "claim long, task string, field string, value string, citations array<struct<source: string, quote: string, near: int>>"


def test_nearest_start_against_all_starts(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        text = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 40)))
        quote = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 3)))
        rows.append((text, quote, rng.randint(0, 45)))
    rows += [("aaaa", "aa", 1), ("", "a", 0), ("a", "", 0), (None, "a", 0), ("abc", None, 0)]
    frame = spark.createDataFrame(rows, "text string, quote string, near int")
    got = frame.select("text", "quote", "near", rebasing.nearest_start(F.col("text"), F.col("quote"), F.col("near")).alias("s")).collect()
    for r in got:
        starts = [i for i in range(len(r.text)) if r.text.startswith(r.quote, i)] if r.text and r.quote else []
        assert r.s == (min(starts, key=lambda s: abs(s - r.near)) if starts else None), r


def test_claims_are_carried_over_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(rebasing, "CHUNK", 2)
    documents = spark.createDataFrame([("s1", "d1", "the fee is 100 EUR. the fee is 100 EUR, yes", ["t"]), ("s2", "d2", "staff of 20", ["t", "u"])], "source string, document string, text string, tasks array<string>")
    fee, staff, lost = ("s1", "fee is 100", 30), ("s2", "staff of 20", 0), ("s1", "fee is 200", 4)
    claims = [
        (1, "t", "fee", "100", [fee]),
        (2, "t", "fee", "100", [fee]),  # again
        (3, "t", "fee", "200", [lost, staff]),  # one quote is gone: the whole claim goes
        (4, "t", "fee", "200", [staff, ("s1", "fee is 100", 0)]),  # the same key, all quotes there
        (5, "t", "fee", "200", [lost, staff]),  # too late to be discarded
        (6, "u", "fee", "1", [fee]),  # not a document of the task
        (7, "t", "known", "1", [fee]),
        (8, "t", "fee", "3", [("s9", "x", 0)]),
        (9, "t", "fee", "4", []),
        (10, "t", "fee", "5", [fee, ("s1", None, 0)]),
        (11, "t", "fee", "6", None),
        (12, None, None, None, [fee]),
    ]
    prior = spark.createDataFrame([("t", "known", "1", ["s1"])], "task string, field string, value string, sources array<string>")
    additive = spark.createDataFrame([("s1",), ("s2",), ("s2",), (None,)], "source string")
    rows = {r.claim: r for r in rebasing.rebased(spark.createDataFrame(claims, CLAIMS), prior, documents, additive).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {1: "carried", 2: "repeated", 3: "discarded", 4: "carried", 5: "repeated", 6: "discarded", 7: "repeated", 8: "skipped", 9: "skipped", 10: "skipped", 11: "skipped", 12: "discarded"}
    assert [c.start for c in rows[1].citations] == [24] and [c.start for c in rows[4].citations] == [0, 4]
    texts = {r.document: r.text for r in documents.collect()}
    for r in rows.values():
        for c, (_, quote, _) in zip(r.citations or [], claims[r.claim - 1][4] or [], strict=False):
            assert texts[c.document][c.start : c.end] == quote
    assert rows[1].claim_id.startswith("claim-") and rows[1].claim_id != rows[4].claim_id and rows[3].claim_id is None


def test_a_text_is_read_once_for_the_citations_of_a_source(spark, monkeypatch):
    text = "".join(f"{i:03d} " for i in range(200))
    monkeypatch.setattr(rebasing, "CHUNK", 50)
    claims = spark.createDataFrame([(i, "t", f"f{i}", "v", [(s, f"{i % 200:03d} ", i)]) for s, ids in (("s1", range(40)), ("s2", range(500, 900))) for i in ids], CLAIMS)
    cited = claims.select("claim", F.posexplode("citations").alias("at", "c")).select("claim", "at", "c.source")
    parts = {r.source: r["count"] for r in rebasing.dealt(cited)[0].select("source", "_part").distinct().groupBy("source").count().collect()}
    assert parts == {"s1": 1, "s2": 8}
    documents = spark.createDataFrame([(s, s, text, ["t"]) for s in ("s1", "s2")], "source string, document string, text string, tasks array<string>")
    rows = rebasing.rebased(claims, claims.selectExpr("task", "field", "value", "array('none') AS sources"), documents, documents.select("source"))
    assert {(r.claim, r.outcome, r.citations[0].start) for r in rows.collect()} == {(i, "carried", text.index(f"{i % 200:03d} ")) for i in [*range(40), *range(500, 900)]}
    # What the first claim of a key and those after it ask for is searched before, not in the plan of each.
    assert "locate(" not in rows._jdf.queryExecution().executedPlan().toString()


# ---- exactly once ----

EVENT = "event_id string, ts long, body string"


def _ledger(spark, tmp_path, log=None):
    def attempt(rows):
        bad = F.when(F.col("body") == "never", "no such owner").when((F.col("body") == "later") & (F.col("attempts") == 0), "temporary failure")
        return rows.withColumn("error", bad)

    return effects.Ledger(spark, str(tmp_path / "ledger"), "event_id", "ts", attempt)


def _wave(spark, tmp_path, *rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def _feed(spark, tmp_path, ledger):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    effects.run(stream, ledger, str(tmp_path / "checkpoint"))


def _done(ledger):
    return sorted((r.event_id, r.body) for r in ledger.effects().collect()), sorted((r.event_id, r.error, r.attempts) for r in ledger.failed().collect())


def test_events_take_effect_once_over_batches(spark, tmp_path):
    _wave(spark, tmp_path, ("a", 1, "x"), ("a", 0, "first"), ("b", 1, "later"), ("c", 1, "never"), (None, 1, "x"))
    ledger = _ledger(spark, tmp_path)
    _feed(spark, tmp_path, ledger)
    assert _done(ledger) == ([("a", "first")], [("b", "temporary failure", 1), ("c", "no such owner", 1)])
    _wave(spark, tmp_path, ("a", 2, "again"), ("c", 2, "mended"))
    _feed(spark, tmp_path, ledger)
    # b is tried again by itself, c with what was delivered anew.
    assert _done(ledger) == ([("a", "first"), ("b", "later"), ("c", "mended")], [])
    _wave(spark, tmp_path, ("b", 3, "x"))
    _feed(spark, tmp_path, ledger)
    assert len(_done(ledger)[0]) == 3


@pytest.mark.parametrize("dies", ["before", "after"])
def test_a_batch_killed_at_its_commit_changes_nothing(spark, tmp_path, dies):
    _wave(spark, tmp_path, ("a", 1, "x"), ("b", 1, "later"))
    ledger = _ledger(spark, tmp_path)
    _feed(spark, tmp_path, ledger)
    _wave(spark, tmp_path, ("d", 1, "x"), ("a", 1, "x"))
    own, killed = ledger.commit, []

    def kill(number):
        if not killed:
            killed.append(number)
            if dies == "after":
                own(number)
            raise RuntimeError("killed")
        own(number)

    ledger.commit = kill
    with pytest.raises(Exception, match="killed"):
        _feed(spark, tmp_path, ledger)
    if dies == "before":  # what the dead batch wrote is there, but does not count
        assert _done(ledger) == ([("a", "x")], [("b", "temporary failure", 1)])
    again = _ledger(spark, tmp_path)
    _feed(spark, tmp_path, again)
    assert _done(again) == ([("a", "x"), ("b", "later"), ("d", "x")], [])
    again.retry()
    assert _done(again) == ([("a", "x"), ("b", "later"), ("d", "x")], [])


# ---- repair ----


def _loop(spark, tmp_path, moves, limits):
    """``moves`` are run, round, quality, passed, cost."""
    table = spark.createDataFrame(moves, "run long, n int, q double, p boolean, c double")
    asked = []

    def step(open_):
        asked.append(sorted(r.run for r in open_.select("run").collect()))
        now = open_.select("run", (F.col("round") + 1).alias("n")).join(table, ["run", "n"])
        return now.select("run", F.col("q").alias("quality"), F.col("p").alias("passed"), F.col("c").alias("cost"))

    return rounds.Loop(spark, str(tmp_path / "loop"), step, limits), asked


MOVES = [
    (1, 1, 50.0, False, 0.1), (1, 2, 96.0, True, 0.1),
    (2, 1, 10.0, False, 0.1), (2, 2, 11.0, False, 0.1), (2, 3, 12.0, False, 0.1),
    (3, 1, 10.0, False, None),
    (4, 1, 10.0, False, 0.6), (4, 2, 20.0, False, 0.6), (4, 3, 30.0, False, 0.6),
    (5, 1, 10.0, False, 0.0), (5, 2, 20.0, False, 0.0), (5, 3, 30.0, False, 0.0), (5, 4, 40.0, False, 0.0),
    (7, 1, None, None, 0.1),
]
RUNS = [(1, 0.0, False), (2, 0.0, False), (3, 0.0, False), (4, 0.0, False), (5, 0.0, False), (6, 99.0, True), (7, 0.0, None), (8, 0.0, False)]
WANT = {1: (2, "passed"), 2: (3, "stagnant"), 3: (1, "cost_unknown"), 4: (2, "budget"), 5: (3, "limit"), 6: (0, "passed"), 7: (1, "nothing_to_do"), 8: (0, "nothing_to_do")}


def test_each_run_stops_for_its_own_reason(spark, tmp_path):
    loop, asked = _loop(spark, tmp_path, MOVES, rounds.Limits(rounds=3, cost=1.0, gain=3, stagnant=2))
    runs = spark.createDataFrame(RUNS, "run long, quality double, passed boolean")
    got = loop.run(runs).collect()
    assert {r.run: (r.round, r.stop) for r in got} == WANT and len(got) == len(RUNS)
    # A round sees the runs that the last one left open, no others.
    assert asked == [[1, 2, 3, 4, 5, 7, 8], [1, 2, 4, 5, 7], [2, 5]]
    assert sorted((r.run, r.round) for r in loop.audit().collect() if r.run == 5) == [(5, 1), (5, 2), (5, 3)]


@pytest.mark.parametrize("lost", [1, 2])
def test_a_loop_goes_on_after_a_lost_round(spark, tmp_path, lost):
    limits = rounds.Limits(rounds=3, cost=1.0, gain=3, stagnant=2)
    loop, _ = _loop(spark, tmp_path, MOVES, limits)
    runs = spark.createDataFrame(RUNS, "run long, quality double, passed boolean")
    own = loop.write

    def dies(number, before):
        own(number, before)
        if number == lost:
            (tmp_path / "loop" / f"round-{number:05d}" / "_SUCCESS").unlink()  # written in part
            raise RuntimeError("lost")

    loop.write = dies
    with pytest.raises(RuntimeError):
        loop.run(runs)
    again, asked = _loop(spark, tmp_path, MOVES, limits)
    assert {r.run: (r.round, r.stop) for r in again.run(runs).collect()} == WANT and len(asked) == 4 - lost
    assert again.run(runs).count() == len(RUNS) and len(asked) == 4 - lost  # nothing is done twice


def test_a_loop_over_no_runs(spark, tmp_path):
    loop, _ = _loop(spark, tmp_path, MOVES, rounds.Limits(rounds=3, cost=1.0, gain=3, stagnant=2))
    assert loop.run(spark.createDataFrame([], "run long, quality double, passed boolean")).collect() == []


# ---- releases ----


def _log(spark, events, fields):
    frame = spark.createDataFrame(events, "entity string, seq long, kind string, target long, payload string").repartition(3)
    times = releases.timeline(frame)
    return releases.versions(times, spark.createDataFrame(fields, "entity string, release long, field string, value string")), times


EVENTS = [("a", 1, "release", None, "p"), ("a", 2, "release", None, "q"), ("a", 3, "release", None, "r"), ("a", 4, "withdraw", 2, None), ("a", 5, "withdraw", 3, None), ("a", 6, "withdraw", 3, None), ("a", 7, "withdraw", 1, None), ("b", 1, "withdraw", 9, None), ("b", 2, "release", None, None)]
VALUES = [("a", 1, "fee", "10"), ("a", 1, "site", "x"), ("a", 2, "fee", "20"), ("a", 3, "fee", "30"), ("a", 3, "staff", "5"), ("b", 2, "fee", "1")]


def test_a_withdrawal_brings_back_what_stood_before(spark):
    log, _ = _log(spark, EVENTS, VALUES)
    at = lambda t: sorted((r.entity, r.field, r.value) for r in releases.as_of(log, t).collect() if r.entity == "a")
    assert at(0) == [] and at(1) == [("a", "fee", "10"), ("a", "site", "x")] and at(2) == [("a", "fee", "20")]
    assert at(3) == at(4) == [("a", "fee", "30"), ("a", "staff", "5")]  # a release in the middle of the chain goes: nothing changes yet
    assert at(5) == at(6) == [("a", "fee", "10"), ("a", "site", "x")]  # the one in the middle is passed over
    assert at(7) == []
    previous = {(r.valid_from, r.field): r.previous for r in log.collect() if r.entity == "a"}
    assert previous == {(1, "fee"): None, (1, "site"): None, (2, "fee"): "10", (3, "fee"): "20", (3, "staff"): None, (5, "fee"): "30", (5, "site"): None}


def test_versions_against_a_walk(spark):
    rng = random.Random(6)
    events = []
    for e in "abcdef":
        for seq in range(1, 40):
            back = rng.random() < 0.5 and seq > 1
            events.append((e, seq, "withdraw" if back else "release", rng.randint(1, seq - 1) if back else None, "x"))
    fields = [(e, s, f, f"{e}{s}{f}") for e, s, k, _, _ in events if k == "release" for f in rng.sample("uvw", 2)]
    log, _ = _log(spark, events, fields)
    rows = log.collect()
    for e in "abcdef":
        alive = []
        for _, seq, kind, target, _ in (x for x in events if x[0] == e):
            alive = [*alive, seq] if kind == "release" else [x for x in alive if x != target]
            want = {f: v for n, s, f, v in fields if n == e and alive and s == alive[-1]}
            assert {r.field: r.value for r in rows if r.entity == e and r.valid_from <= seq and (r.valid_to is None or r.valid_to > seq)} == want


def test_the_chain_of_hashes_shows_a_change_in_the_past(spark):
    hashes = lambda events: {(r.entity, r.seq): r.sha256 for r in _log(spark, events, VALUES)[1].collect()}
    first = hashes(EVENTS)
    second = hashes([(*EVENTS[1][:4], "other") if i == 1 else e for i, e in enumerate(EVENTS)])
    assert {k for k in first if first[k] != second[k]} == {("a", s) for s in range(2, 8)}
    assert len(hashes(EVENTS[:3] + EVENTS[4:])) == len(first) - 1 and hashes(EVENTS[:3] + EVENTS[4:])["a", 5] != first["a", 5]


# ---- claims and queries ----


def test_bounded_claims_against_a_walk(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        run = "hot" if rng.random() < 0.5 else rng.choice("ab")
        rows.append((run, i, rng.choice("tu"), rng.choice(["fee", "site", "secret"]), rng.choice(["v", "v", " ", None]), rng.choice(["not_reviewed", "not_reviewed", "accepted", None]), rng.choice([False, False, True, None]), rng.choice([None, [], [1], [1, 1], [1, 2], [2, 3, 9], [None, 4]])))
    frame = spark.createDataFrame(rows, "run string, claim long, task string, field string, value string, verdict string, unsafe boolean, sources array<long>").repartition(4)
    kinds = {1: "official", 2: "registry", 3: "news", 4: "official"}
    policy = {"fee": (["official", "registry"], 2), "site": (["official"], 1)}
    sources = spark.createDataFrame(list(kinds.items()), "source long, source_type string")
    policies = spark.createDataFrame([(f, *p) for f, p in policy.items()], "field string, accepted array<string>, minimum int")
    want, taken = [], {}
    for run, claim, task, field, value, verdict, unsafe, cited in rows:
        if verdict != "not_reviewed" or unsafe or not (value or "").strip() or field not in policy:
            continue
        accepted, minimum = policy[field]
        if len({s for s in cited or [] if kinds.get(s) in accepted}) < minimum:
            continue
        mine = taken.setdefault(run, [])
        if len(mine) < 7 and mine.count((task, field)) < 3:
            mine.append((task, field))
            want.append((run, task, field, claim))
    got = claims.bounded_claims(frame, sources, policies, per_field=3, per_run=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert claims.bounded_claims(frame.limit(0), sources, policies).collect() == []


def test_queries_go_to_the_tasks_that_planned_them(spark):
    tasks = spark.createDataFrame([("t1", 1, ["Fee  of X", None]), ("t2", 0, ["fee of x"]), ("t3", 2, ["other"]), ("t4", 3, None)], "task string, place int, queries array<string>")
    reported = spark.createDataFrame([("t3", "fee of x"), ("t3", "free"), ("t4", " FREE "), ("gone", "free"), ("t1", None)], "task string, query string")
    actions = spark.createDataFrame(
        [(1, ["t1", "t2", "t3"], ["FEE of x ", "free", "nothing", None]), (2, ["t3"], ["fee of x"]), (3, ["t4", "t3"], ["Free"]), (4, None, ["other"]), (5, ["t1"], None)],
        "action long, scope array<string>, queries array<string>",
    )
    got = {(r.action, r.at): (r.query, r.tasks) for r in claims.attributed(actions, tasks, reported).collect()}
    # A query that was planned is not the reporters', not even where its planners are out of scope (action 2).
    assert got == {(1, 0): ("FEE of x ", ["t2", "t1"]), (1, 1): ("free", ["t3"]), (3, 0): ("Free", ["t3", "t4"])}


def test_a_key_of_all_tasks_meets_only_tasks_in_scope(spark):
    tasks = spark.range(40_000).selectExpr("id AS task", "id AS place", "array('Same  query') AS queries")
    actions = spark.range(40_000).selectExpr("id AS action", "array(id, id) AS scope", "array('same query', 'other') AS queries")
    reported = spark.createDataFrame([], "task long, query string")
    began = time.time()
    rows = claims.attributed(actions, tasks, reported)
    assert rows.filter("tasks = array(action) AND at = 0").count() == rows.count() == 40_000 and time.time() - began < 60


def test_claims_are_not_dealt_by_field_or_source_alone(spark):
    frame = spark.createDataFrame([], "run long, claim long, task long, field string, value string, verdict string, unsafe boolean, sources array<long>")
    sources, policies = spark.createDataFrame([], "source long, source_type string"), spark.createDataFrame([], "field string, accepted array<string>, minimum int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = claims.bounded_claims(frame.repartition(2), sources.repartition(2), policies.repartition(2))
        plan = rows._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert re.search(r"hashpartitioning\(field#\d+, _part#\d+", plan) and re.search(r"hashpartitioning\(source#\d+L?, _part#\d+", plan)
