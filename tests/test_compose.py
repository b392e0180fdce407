"""Whole stages on small tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import compose


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cities(spark):
    data = [(0, "Weifang", "7601", "a"), (1, "Jinan", "12757", "b"), (2, "Weifang", "", "c"), (3, "", "1", "d"), (4, None, None, "e")]
    return spark.createDataFrame(data, "record_idx long, city string, gdp string, _mark string")


def test_merge_with_given_keys(spark, cities):
    """Similar records stay apart; columns with `_` go; an empty list of keys merges nothing."""
    near = spark.createDataFrame([(0, "City of Weifang in Shandong", "1"), (1, "City of Weifang in Shandong.", "1")], "record_idx long, city string, gdp string")
    assert compose.merge_records(near, ["city", "gdp"], ["city"]).count() == 2
    assert compose.merge_records(near, ["city", "gdp"], []).count() == 2
    assert compose.merge_records(near, ["city", "gdp"], least=0.9).count() == 1
    got = compose.merge_records(cities, ["city", "gdp", "_mark"], ["city"])
    assert got.columns == ["city", "gdp", "record_idx", "merge_count"]
    assert rows(got.where("city = 'Weifang'"), "gdp", "merge_count") == [("7601", 2)] and got.count() == 4


def test_chunk_results(spark, cities):
    merged, stats = compose.merge_chunk_results(cities, ["city", "gdp"], ["city"])
    s = stats.first()
    assert (s.total, s.merged, round(s.reduction, 3), s["keys"]) == (5, 4, 0.2, ["city"]) and merged.count() == 4
    s = compose.merge_chunk_results(cities.limit(0), ["city", "gdp"])[1].first()
    assert (s.total, s.merged, s.reduction, s["keys"]) == (0, 0, 0.0, [])
    numbered = spark.createDataFrame([(i, str(i % 7), f"v{i}") for i in range(20)], "record_idx long, id string, v string")
    assert "id" in compose.merge_chunk_results(numbered, ["id", "v"])[1].first()["keys"]


SPECS = [(0, "city", "Weifang", 0, {"unit": "t"}), (1, "city", "none", 0, {"unit": "kg"}), (2, "city", "none", 0, {"unit": " "}), (3, "", "", 0, {"unit": "x"}), (4, "city", "Jinan", 0, {})]


@pytest.fixture(scope="module")
def tables(spark):
    specs = spark.createDataFrame(SPECS, "table_index int, filter_field string, filter_value string, max_rows int, fixed_values map<string,string>")
    source = spark.createDataFrame([(0, "Weifang city", "35", ""), (1, "Weifang", "", "g"), (2, "Jinan", "40", "g")], "record_idx long, city string, pm string, unit string")
    groups = spark.createDataFrame([(0, 9, "Weifang", "", ""), (3, 8, "", "", "only"), (4, 7, "Jinan", "", "y"), (9, 6, "a", "b", "c")], "table_index int, record_idx long, city string, pm string, unit string")
    return specs, source, groups


def test_weak_groups_are_replaced(tables):
    specs, source, groups = tables
    got = rows(compose.replace_weak(groups, specs, source, ["city", "pm", "unit"]), "table_index", "record_idx", "city", "pm", "unit")
    assert got == sorted([(0, 0, "Weifang city", "35", "t"), (0, 1, "Weifang", "", "t"), (1, -1, "", "", "kg"), (3, 8, "", "", "only"), (4, 7, "Jinan", "", "y"), (9, 6, "a", "b", "c")], key=repr)


def test_groups_are_filled(tables):
    """The sound group takes what it lacks and keeps what it has; without a filter a weak group takes all."""
    specs, source, groups = tables
    got = rows(compose.fill_groups(groups, specs, source, ["city", "pm", "unit"]), "table_index", "record_idx", "city", "pm", "unit")
    assert got == sorted([(0, 0, "Weifang city", "35", ""), (0, 1, "Weifang", "", "g"), (3, 0, "Weifang city", "35", ""), (3, 1, "Weifang", "", "g"), (3, 2, "Jinan", "40", "g"), (4, 7, "Jinan", "40", "y"), (9, 6, "a", "b", "c")], key=repr)


def test_postprocess(spark):
    data = [(1, i, n, d, "a" if i != 2 else "") for i, (n, d) in enumerate([("Zeta", "2020/7/1"), ("Alpha", "2020年8月2日"), ("Beta", "2020-08-01"), ("Zeta", "2020-07-01"), ("Late", "2021-01-01"), ("Old", ""), ("Gamma", "2020-07-30"), ("Delta", "2020-07-30")])]
    df = spark.createDataFrame(data, "task long, record_idx long, title string, seen string, grp string")
    profile = compose.Profile({"name": "text", "day": "date", "grp": "text"}, {"name": ["title"], "day": ["seen"]}, keys=["name", "day"], date_range=("2020-07-01", "2020-08-31"), backfill=["grp"], rules=[("name", "!=", "Delta")])
    texts = spark.createDataFrame([(1, "Alpha then Beta, and Zeta")], "task long, text string")
    out, summary = compose.postprocess(df, profile, ["task"], texts)
    assert [(r.name, r.day, r.grp) for r in out.orderBy("rank").collect()] == [("Alpha", "2020-08-02", "a"), ("Beta", "2020-08-01", "a"), ("Zeta", "2020-07-01", "a"), ("Gamma", "2020-07-30", "a")]
    assert rows(summary, "task", "records", "distinct", "in_range", "kept", "backfilled") == [(1, 8, 7, 5, 4, 1)]
    out, summary = compose.postprocess(df.limit(0), profile, ["task"], texts)
    assert out.count() == summary.count() == 0


def test_extract(spark):
    data = [(1, 0, "City: Weifang, PM: 35"), (1, 1, "nothing"), (1, 2, "CITY: Jinan"), (2, 0, "depth: 4"), (3, 0, None), (4, 0, "")]
    chunks = spark.createDataFrame(data, "doc_id long, chunk_idx int, text string")
    profile = compose.Profile({"city": "text", "pm": "number"}, required=["city", "pm"])
    got = compose.extract(chunks, profile)
    assert rows(got["records"], "doc_id", "city", "pm") == [(1, "Jinan", ""), (1, "Weifang", "35")]
    assert rows(got["rejects"], "doc_id", "chunk_idx", "reason") == [(1, 1, "no field"), (2, 0, "no field of the profile"), (3, 0, "no field"), (4, 0, "no field")]
    assert rows(got["summary"], "doc_id", "records", "missing", "retried", "chars") == [(1, 2, 1, 1, 39), (2, 0, 0, 0, 8), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
    assert got["audit"].groupBy("status").count().where("status = 'empty'").first()["count"] == 1
    plain = compose.extract(chunks, hit=F.col("text").contains("PM"))
    assert rows(plain["records"].where("doc_id = 1"), "chunk_idx", "field", "value") == [(0, "City", "Weifang"), (0, "PM", "35")]


def test_units(spark):
    from quire.operators import layout

    data = [
        (1, '{"units": [{"unit_id": "a", "unit_type": "t", "confidence": "high", "fields": {"x": 1}}, 5, {"y": "2", "evidence": "e", "confidence": -3}]}'),
        (2, '{"units": [{"fields": [{"key": "k", "value": "v"}, {"key": "k", "value": "w"}, 3, ["l", 4], ["m"]]}, {"fields": "odd", "confidence": 9}]}'),
        (3, '{"units": []}'),
        (4, "{}"),
        (5, None),
    ]
    u = layout.units(spark.createDataFrame(data, "i int, j string"), "j")
    assert rows(u, "i", "unit_id", "unit_type", "confidence", "evidence") == [(1, "a", "t", 0.8, ""), (1, "unit_003", "unknown", 0.0, "e"), (2, "unit_001", "unknown", 0.8, ""), (2, "unit_002", "unknown", 1.0, "")]
    assert {(r.i, r.unit_id): r.fields for r in u.collect()} == {(1, "a"): {"x": "1"}, (1, "unit_003"): {"y": "2"}, (2, "unit_001"): {"k": "w", "l": "4"}, (2, "unit_002"): {}}
    assert rows(layout.unit_summary(u, ["i"]), "i", "unit_count", "unit_types") == [(1, 2, ["t", "unknown"]), (2, 2, ["unknown"])]
