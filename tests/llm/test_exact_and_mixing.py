import duckdb
import pytest

from tessera.llm import exact_dedup, mixing

from .common import edge_docs


def _oracle(spark_df, sql):
    documents = spark_df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    return sorted(map(repr, duckdb.sql(sql).fetchall()))


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_exact_dedup_matches_sql_on_edge_rows(spark):
    docs = edge_docs(spark)
    rows = {r.doc_id: r for r in exact_dedup.dedup(docs).collect() if r.doc_id is not None}
    assert exact_dedup.dedup(docs).count() == docs.count()
    assert rows[2].keep_id == 1 and not rows[2].kept and rows[2].group_size == 4
    assert rows[4].keep_id == 3 and rows[3].kept  # null counts as empty
    assert rows[7].keep_id == 6
    assert rows[5].keep_id == 5  # white space alone is one space, not empty
    some = docs.filter("doc_id IS NOT NULL")
    assert _rows(exact_dedup.dedup(some)) == _oracle(some, exact_dedup.ORACLE)


def test_exact_dedup_spreads_a_hot_group_and_takes_an_empty_table(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE cast(id AS string) END AS text")
    rows = exact_dedup.dedup(docs).filter("group_size > 1").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {0} and {r.group_size for r in rows} == {1000}
    per_run = exact_dedup.dealt(exact_dedup.digest_rows(docs), 32).filter("n_bytes = 4").groupBy("run").count().collect()
    assert max(r["count"] for r in per_run if r["count"]) < 200
    assert exact_dedup.dedup(docs.limit(0)).collect() == []


def test_runs_are_sorted_before_they_merge_and_one_repeated_row_stays(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (2, "a b"), (None, "a b"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup.dedup(docs)
    got = found.collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.keep_id == 1) == [(1, 5, False)] * 4 + [(1, 5, True)]
    assert sorted((r.group_size, r.kept) for r in got if r.keep_id is None) == [(2, False), (2, True)]
    plan = exact_dedup.merged(exact_dedup.leaves(exact_dedup.dealt(exact_dedup.digest_rows(docs), 32)))._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" +-:*()0123456789") for x in plan.split("\n")]
    window = next(i for i, x in enumerate(lines) if x.startswith("Window ["))
    # Nothing but the sort of the two runs, and one exchange, stands between the window and the leaves.
    assert [x.split(" ")[0] for x in lines[window + 1 :] if x.startswith(("Sort ", "Exchange", "SortAggregate", "HashAggregate", "ObjectHashAggregate"))][:2] == ["Sort", "Exchange"]
    assert "run#" in lines[window + 1] + lines[window + 2] and "sha#" in lines[window + 1] + lines[window + 2]


@pytest.mark.parametrize("rows_a_run", [1, 40])
def test_runs_grow_with_the_rows_and_rows_without_an_id_spread(spark, monkeypatch, rows_a_run):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", rows_a_run)
    docs = spark.range(400).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS doc_id", "concat('t', id % 3) AS text").repartition(4)
    rows = exact_dedup.dedup(docs).collect()
    assert len(rows) == 400 and sum(r.kept for r in rows) == 3 and {r.keep_id for r in rows} == {1, 3, 5}
    per_run = exact_dedup.dealt(exact_dedup.digest_rows(docs.filter("doc_id IS NULL")), 32).groupBy("run").count().collect()
    assert len(per_run) == 32 and max(r["count"] for r in per_run) < 25


def test_mixing_matches_sql_and_budgets(spark):
    docs = edge_docs(spark).filter("doc_id IS NOT NULL")
    found = mixing.mix(docs).collect()
    want = _oracle(docs, mixing.ORACLE)
    assert sorted(repr((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in found) == want
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("counts", [(100, 100, 100), (1000, 5, 5, 300), (7,), (0, 10, 10)])
def test_targets_by_resharing(spark, counts):
    """The running-sum form equals resharing step by step."""
    sizes = spark.createDataFrame([(f"s{i}", f"{i}", c, 1) for i, c in enumerate(counts)], "skey string, source string, source_size long, docs long")
    got = {int(r.source): r.target for r in mixing.targets(sizes).collect()}
    weight = [(5, 2, 1)[i % 3] for i in range(len(counts))]
    target, capped = [0.0] * len(counts), set()
    while True:
        free = [i for i in range(len(counts)) if i not in capped]
        rest = sum(counts) - sum(3 * counts[i] for i in capped)
        for i in free:
            target[i] = rest * weight[i] / sum(weight[j] for j in free)
        over = {i for i in free if target[i] >= 3 * counts[i]}
        if not over:
            break
        capped |= over
        for i in over:
            target[i] = 3.0 * counts[i]
    assert all(abs(got[i] - target[i]) < 1e-6 for i in range(len(counts)))


def test_mix_takes_each_source_to_its_target_in_any_partitioning(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 50 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    a, b = mixing.mix(docs), mixing.mix(docs.repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())
    for r in a.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1
