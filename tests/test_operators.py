"""Literal cases of the record operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import answers
from quire.operators import chunks as C
from quire.operators import infer as K
from quire.operators import mapping, privacy
from quire.operators import predicates as E
from quire.operators import records as R
from quire.operators import retrieval
from quire.streaming.arrivals import call_windows, fresh_documents, run_stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("64 例", "64"), ("12.6 万份", "12.6"), ("5号楼", "5"), ("约3人", "约3人"), ("", ""), ("-1.5%", "-1.5")])
def test_clean_number_of_text(spark, value, want):
    assert one(spark, lambda c: V.clean_number(c, "text"), value) == want


@pytest.mark.parametrize(("value", "want"), [("3.5亿元", "350000000"), ("12万", "120000"), ("1,234.50", "1234.50"), ("2百万", "2000000"), ("无", None), ("（预估）7", "7")])
def test_money_rule(spark, value, want):
    assert one(spark, lambda c: V.by_rule(c, "money", V.MONEY_UNITS), value) == want


@pytest.mark.parametrize(("value", "want"), [("2024年3月5日", "2024-03-05"), ("2024/3/5", "2024-03-05"), ("2024-03", "2024-03-01"), ("soon", None)])
def test_date_rule(spark, value, want):
    assert one(spark, V.date_by_rule, value) == want


@pytest.mark.parametrize(("n", "want"), [(0, "零元整"), (10, "壹拾元整"), (1005, "壹仟零伍元整"), (100001, "壹拾万壹元整"), (12345678, "壹仟贰佰叁拾肆万伍仟陆佰柒拾捌元整"), (100000000, "壹亿元整")])
def test_upper_amount(spark, n, want):
    assert one(spark, V.upper_amount, n, "long") == want


def test_keys_and_tokens(spark):
    assert one(spark, V.key_loose, " 1,234 万元 ") == "1234"
    assert one(spark, V.key_strict, "A b,c 亿") == "Abc"
    assert one(spark, V.tokens, "GDP 总量 2024") == ["gdp", "2024", "总", "量", "总量"]
    assert one(spark, V.all_dates, "a 2024-02-31 b 2024-1-5") == [datetime.date(2024, 1, 5)]


def test_pack_keeps_text_and_lets_long_parts_stand_alone(spark):
    d = spark.createDataFrame([(["aaaa", "bbbbbbbbbb", "c", "d"],), ([],)], "p array<string>")
    got = [r.y for r in d.select(C.pack(F.col("p"), F.lit(5)).alias("y")).collect()]
    assert got == [["aaaa", "bbbbbbbbbb", "c\nd"], []]


def test_sentence_windows(spark):
    text = "x" * 300 + "。" + "y" * 400
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.start, r.end) for r in C.sentence_windows(d).orderBy("start").collect()]
    assert got == [(0, 301), (221, 701)]


def test_markdown(spark):
    d = spark.createDataFrame([(1, "| a | b |\n| --- | :-: |\n| 1 | 2 |\n\n| 3 |"), (2, "no table")], "doc_id long, markdown string")
    assert [(r.row_idx, r.row) for r in C.markdown_rows(d).orderBy("row_idx").collect()] == [(0, {"a": "1", "b": "2"}), (1, {"a": "3", "b": ""})]


def test_date_range_rows(spark):
    d = spark.createDataFrame([("A", "2020/7/1"), ("B", "2020年8月31日"), ("C", "2020-09-01"), ("D", "")], "k string, d string")
    assert [r.k for r in E.in_date_range(d, E.date_column(d, []), "2020-07-01", "2020-08-31").orderBy("k").collect()] == ["A", "B"]
    assert E.in_date_range(d, None, "2020-07-01", "2020-08-31").count() == 4


def test_rules_keep_what_they_cannot_read(spark):
    d = spark.createDataFrame([("x", "12"), ("y", "n/a"), ("z", "3")], "k string, v string")
    assert {r.k for r in E.keep_rows(d, [("v", ">", 5)]).collect()} == {"x", "y"}
    assert {r.k for r in E.matching_rows(d, ("v", ">", 5)).collect()} == {"x"}
    assert {r.k for r in E.keep_rows(d, [("v", ">", "abc")]).collect()} == {"x", "y", "z"}


def test_merge_and_carry(spark):
    d = spark.createDataFrame([(1, "a", "x", ""), (2, "a", "", "long"), (3, " ", "q", "r"), (4, "a", "yy", "l")], "record_idx long, k string, p string, q string")
    got = R.merge_by_key(d, ["k"], ["k", "p", "q"]).orderBy("unkeyed", "record_idx").collect()
    assert [(r.k, r.p, r.q, r.merge_count) for r in got] == [("a", "yy", "long", 3), (" ", "q", "r", 1)]
    filled = R.carry_forward(d.withColumn("t", F.lit(1)), ["p"], ["t"]).orderBy("record_idx").collect()
    assert [(r.p, r._filled) for r in filled] == [("x", 0), ("x", 1), ("q", 0), ("yy", 0)]
    assert R.exact_dedup(d.union(d), ["k", "p", "q"]).count() == 4
    assert R.choose_keys(d, ["missing"]) == ["k", "p", "q"]


def test_resolve_columns():
    aliases = {"金额": ["amount", "total"]}
    assert mapping.resolve("金额", ["Total（元）", "x"], aliases) == "Total（元）"
    assert mapping.resolve("municipality", ["municipalty"], {}) == "municipalty"
    assert mapping.resolve("a", ["zzz"], {}) is None


def test_redaction_round_trip(spark):
    text = "a 13812345678 b x@y.com c 13912345678 id 110101200003070012"
    r = privacy.restore(privacy.redact(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert r[0].restored == text and "@" not in r[0].redacted and "1381" not in r[0].redacted
    assert [x.placeholder for x in r[0].redactions] == ["⟦mobile_1⟧", "⟦mobile_2⟧", "⟦id_number_3⟧", "⟦email_4⟧"]
    assert r[1].restored == "" and r[1].redactions == []


def test_boost_and_top_k(spark):
    d = spark.createDataFrame([("q", 1, "text", 0.5), ("q", 2, "table", 0.5), ("q", 3, "text", 0.5)], "question string, idx int, type string, score double")
    got = retrieval.top_k(d.withColumn("score", F.col("score") * retrieval.boost("type")), ["question"], ["idx"], 2).orderBy("rank").collect()
    assert [r.idx for r in got] == [2, 1]


def test_json_repair(spark):
    d = spark.createDataFrame([(1, '{"a": 1}'), (2, '```json\n{"a": 2,}\n```'), (3, '{"a": 3'), (4, "none")], "i int, t string")
    good, bad = answers.records(d, "t", "a int")
    assert {(r.i, r.record.a) for r in good.collect()} == {(1, 1), (2, 2), (3, 3)} and [r.i for r in bad.collect()] == [4]


def test_model_failures_are_rows(spark):
    def broken(prompts):
        raise ValueError("down")

    d = spark.createDataFrame([(1, 0, "p")], "doc_id long, chunk_idx int, prompt string")
    assert K.apply_model(d, broken).first().error == "down"
    assert K.with_fallback(d, [("a", broken), ("b", lambda p: p)]).first().provider == "b"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run_stream(stream, call_windows, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    sums = spark.read.parquet(str(tmp_path / "out")).groupBy("window_start", "event_type").agg(F.sum("calls").alias("calls"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, call_windows(src).select("window_start", "event_type", "calls").collect()))


def test_replays_are_dropped(spark):
    now = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", now), ("a", now), ("b", now)], "text string, ts timestamp")
    assert fresh_documents(d).count() == 2
