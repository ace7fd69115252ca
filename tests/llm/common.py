"""Edge rows that every operator on documents meets: nulls, empty and long texts, repeats, clashing extra columns."""

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size long, fp long, n long"


def edge_docs(spark):
    long_ = " ".join(f"w{i % 700}" for i in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a"),
        (2, "alpha  beta\tgamma delta\nepsilon", "en", "a"),
        (2, "alpha  beta\tgamma delta\nepsilon", "en", "a"),
        (3, None, None, None),
        (4, "", "en", ""),
        (5, " \t\n ", "de", "b"),
        (6, long_, "de", "b"),
        (7, long_, "fr", None),
        (None, "alpha beta gamma delta epsilon", "en", "a"),
        (8, "x" * 5000, None, "c"),
        (9, "漢字 ñandú 🙂 42", "es", "c"),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, True, 1, 2, 3) for r in rows], DDL).coalesce(1)


def on_disk(spark, df, tmp_path):
    """The frame as a table of files."""
    df.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))
