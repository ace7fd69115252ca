import corpus_pipeline
from tessera.llm import queries

from .common import edge_docs


def test_every_stage_is_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    plain = [(i, " ".join(f"t{(i * 7 + j * 13) % 97}x{i}" for j in range(40)), "en", f"s{i % 3}") for i in range(60)]
    rows = plain + [(100, plain[0][1], "en", "s0"), (101, plain[1][1].replace("x1 ", "x1  "), "en", "s1"), (102, plain[2][1] + " !", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == 63 and kept.columns == docs.columns
    kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {*range(60), 102} and kept.columns == docs.columns
    kept = corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert {*range(60)} <= ids and kept.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, kept, str(tmp_path))
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * kept.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_pieces", "ids"]


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.drop_copies(spark, docs, str(tmp_path)).count() == 6


def test_dedup_stages_keep_one_row_of_each_group(spark):
    other, third = (" ".join(f"{k}{j * 31 % 89}" for j in range(60)) for k in "oz")
    near = other + " !"
    rows = [
        # Repeated rows of the smallest id, and a copy of another id.
        (1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "alpha  beta\tgamma"), (5, "alpha beta gamma"),
        # One id with two texts: its copy of the first loses to no one, that of the second loses to id 2.
        (3, "uno dos tres"), (3, "vier funf sechs"), (2, "vier funf sechs"),
        # A group of null ids alone, and a null id whose text an id has.
        (None, other), (None, other), (None, "alpha beta gamma"), (None, third), (None, near),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    key = lambda rows: sorted(((r.doc_id, " ".join(r.text.split())) for r in rows), key=str)
    assert kept.columns == docs.columns
    assert key(kept.collect()) == sorted([(1, "alpha beta gamma"), (3, "uno dos tres"), (2, "vier funf sechs"), (None, other), (None, third), (None, near)], key=str)
    # The near stage alone meets the same rows: one of each component, whatever its ids.
    near_kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    groups = {r.component for r in corpus_pipeline.simhash.members(docs).collect()}
    assert near_kept.columns == docs.columns and near_kept.count() == len(groups)
    found = key(near_kept.collect())
    assert len({t for _, t in found}) == len(found) and (1, "alpha beta gamma") in found and (2, "vier funf sechs") in found and (None, third) in found
