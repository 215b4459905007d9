"""Queries over whole tables against plain Python."""

import duckdb

from framequery.functions.rules import TARGET_WORDS
from framequery.plans import catalog

SF = "/root/testdata/sf0.001"


def test_jo10_finds_keywords_anywhere_in_a_text(spark, tmp_path):
    rows = [(1, "x" * 500 + " JUPITER", "s"), (2, "x" * 500, "s"), (3, None, "Mars"), (4, "mars " + "y" * 300 + " mond", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.target for r in catalog.queries()["jo10_target_detect"](spark, str(tmp_path)).collect()}
    want = {i: next((t for t, words in TARGET_WORDS.items() if any(w in c.lower() for w in words for c in (text or "", source))), None) for i, text, source in rows}
    assert got == want == {1: "Jupiter", 2: None, 3: "Mars", 4: "Moon"}


def test_tk06_places_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value", "ts").collect()
    s = sorted(events, key=lambda r: (r.event_id % 3 != 0, r.value if r.event_id % 3 else 0, r.event_id))
    c = sorted(events, key=lambda r: (r.event_id % 4 == 0, r.ts.timestamp() if r.event_id % 4 else 0, r.event_id))
    by_s, by_c = ({r.event_id: k for k, r in enumerate(rows, 1)} for rows in (s, c))
    got = {r.event_id: (r.by_sharpness, r.by_created) for r in catalog.queries()["tk06_sorted_catalog"](spark, SF).collect()}
    assert len(events) > 400 and got == {i: (by_s[i], by_c[i]) for i in by_s}


def test_jo14_gives_every_stem_its_sibling(spark):
    ids = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    found = {}
    for i in ids:
        found.setdefault(i // 3, set()).add(("tif", "png", "jpg")[i % 3] if i % 5 else None)
    want = {stem: "png" if "png" in x else "tif" if "tif" in x else None for stem, x in found.items()}
    got = catalog.queries()["jo14_sibling"](spark, SF).collect()
    assert max(ids) >= 500 and len(got) == len(want) and {r.stem: r.sibling for r in got} == want


def test_tk07_ranks_no_whole_table_in_one_task(spark, capsys):
    catalog.queries()["tk07_natural_order"](spark, SF).explain()
    windows = [x for x in capsys.readouterr().out.splitlines() if " Window " in x and "row_number" in x]
    assert windows and all("_range" in x.split("row_number", 1)[1] for x in windows)


def test_ru05_follows_its_sql_at_no_value_and_on_rounding_edges(spark, tmp_path):
    rows = [(21488, 0.0), (90816, 36.99), (3, None), (4, 560.21), (5, 0.05)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalog.oracle_sql()["ru05_geometry"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in catalog.queries()["ru05_geometry"](spark, str(tmp_path)).collect()}
    assert got == want and got[21488][2:5] == (200, 10, float("inf")) and got[90816][6] == 0.989688


def test_ag25_sorts_a_plane_once_a_row(spark):
    plan = catalog.queries()["ag25_centroids"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") <= 2 and plan.count("array_max(") == 2
    assert plan.count("aggregate(") == 3


def test_ag15_runs_no_lambda_over_a_shift_map(spark):
    plan = catalog.queries()["ag15_local_accumulate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_flat" in plan and "transform(_flat" not in plan
