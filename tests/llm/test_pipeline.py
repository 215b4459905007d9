"""The pipeline's stages on the smallest table, and on rows made to be caught."""

import corpus_pipeline as cp
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(cp.STAGES) - 1:
            assert now.columns == columns
            assert 0 < now.count() <= n
            docs, n = now, now.count()
    assert now.count() == n and "ids" in now.columns


def test_contaminated_go_and_clean_stay(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, f"Some words before. {item} And after.", "en", "s", 1), (2, "Nothing to see in this one at all.", "en", "s", 1), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.drop_contaminated(spark, docs, SF).collect()) == [2, 3]


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(5, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (9, " ".join(f"other{k}" for k in range(200)), "en", "s", 1), (None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()), key=lambda i: (i is None, i)) == [2, 9, None]


def test_repeated_and_missing_ids_lose_and_keep_no_row_too_many(spark):
    a, b, c, item = (" ".join(f"{w}{k}" for k in range(200)) for w in ("first", "second", "third", "passage"))
    rows = [(7, a), (7, b), (None, c), (None, c), (3, b), (None, a), (None, f"{c} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs.limit(6), SF).collect()]
    assert sorted(kept, key=str) == sorted([(7, a), (3, b), (None, c)], key=str)
    known = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    found = docs.unionByName(spark.createDataFrame([(None, f"x {known} y", "en", "s", 1), (7, f"x {known} y", "en", "s", 1)], docs.schema))
    left = [(r.doc_id, r.text) for r in cp.drop_contaminated(spark, found, SF).collect()]
    assert sorted(left, key=str) == sorted(rows, key=str)


def tables(spark, folder, rows, schema):
    """A folder of tables with these documents and the labels and benchmark of SF."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_an_empty_table_gives_none(spark, tmp_path):
    out = cp.run(spark, tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.count() == 0 and "ids" in out.columns


def test_missing_texts_and_clashing_columns(spark, tmp_path):
    """NULL and empty texts are one class of equal texts; columns with the names of results stay as they were."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, toxic string, kept string, _row string"
    rows = [(k, None, "en", "s", None, *["own"] * 5) for k in (4, 2, 9)] + [(7, "", "en", "s", 0, *["own"] * 5), (8, " ".join(f"Plain{k}" for k in range(90)), "en", "s", 9, *["own"] * 5)]
    sf = tables(spark, tmp_path, rows, schema)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert {r.component_id for r in docs.collect()} <= {"own"}
    assert sorted(r.doc_id for r in docs.collect()) == [2, 8]
    out = {r.doc_id: r for r in cp.encode(spark, docs, sf).collect()}
    assert sorted(out) == [2, 8] and len(out[2].ids) == 0 and len(out[8].ids) > 90


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
