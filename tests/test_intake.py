"""Literal cases of interpretation, layout and fuzzy merges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import fuzzy, interpret, layout
from quire.operators.predicates import any_clause, rows_in_scope, with_neighbours


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [("无新增", "0"), ("新增 68 例，其中境外 5 例", "68"), ("其中甲 3 例、乙 4.5 例", "7.5"), ("7月27日未报告新增病例", "0"), ("暂无数据", ""), ("12.50", "12.5"), ("-3 度", "-3"), ("", ""), (None, ""), ("7月27日新增 9 例", "7")],
)
def test_semantic_number(spark, text, want):
    assert one(spark, lambda c: interpret.semantic_number(c, ["病例"]), text) == want


def test_interpret_reads_the_text_beside_the_anchor(spark):
    d = spark.createDataFrame([("不详", "甲市", "乙市病例 4 例。甲市报告病例 12 例。"), ("不详", "丙市", "没有丙的内容"), ("3", "甲市", "")], "v string, city string, src string")
    got = [r.y for r in d.select(interpret.interpret("v", "病例数", "number", F.col("src"), ["city"]).alias("y")).collect()]
    assert got == ["4", "不详", "3"]
    assert interpret.keywords("病例数量", ["感染人数"]) == ["病例数量", "病例", "感染人数", "感染", "感染人"]
    assert [r.y for r in d.select(interpret.interpret("v", "报告日期", "number", F.col("src"), ["city"]).alias("y")).collect()] == ["不详", "不详", "3"]


def test_company_and_title(spark):
    assert one(spark, interpret.company, "我们，新星科技有限公司与老牌有限公司") == "新星科技有限公司"
    assert one(spark, interpret.project_title, "今天“智慧城市”签约") == "智慧城市"
    assert one(spark, interpret.project_title, "签的是云平台这个项目") == "云平台"


def test_merged_cells(spark):
    cells = [(1, 0, 0, "a", 2, 1, 3), (1, 0, 1, "b", 1, 2, 3), (1, 1, 0, "c", 1, 1, 3), (1, 1, 1, "d", 1, 1, 3)]
    got = layout.expand_spans(spark.createDataFrame(cells, "table_idx long, r int, pos int, text string, row_span int, col_span int, n_cols int"))
    assert {(r.r, r.c): r.text for r in got.collect()} == {(0, 0): "a", (0, 1): "b", (0, 2): "b", (1, 0): "a", (1, 1): "c", (1, 2): "d"}


def test_flatten(spark):
    j = '{"甲": {"n": {"名称": "", "值": 1}}, "list": [{"名称": "y", "值": 2}, 3]}'
    got = layout.flatten_records(spark.createDataFrame([(1, j), (2, "x"), (3, None)], "key long, j string"), "j", ["名称", "值"])
    assert sorted((r.key, r.record["名称"], r.record["值"]) for r in got.collect()) == [(1, "n", "1"), (1, "y", "2")]


def test_instruction_clauses(spark):
    text = "表1：\n监测时间：2025/11/25 09:00\n城市：德州市\n表2：\n监测时间：2025-11-26\n城市：潍坊"
    clauses = layout.compile_instruction(text)
    assert [c.tokens["city"] for c in clauses] == [["德州市", "德州"], ["潍坊", "潍坊市"]]
    assert clauses[0].tokens["monitor_time"] == ["2025/11/25 09:00", "2025-11-25"]
    assert layout.compile_instruction("2020/8/31到2020/7/1")[0].window == ("2020-07-01", "2020-08-31")
    assert layout.compile_instruction("nothing") == []
    d = spark.createDataFrame([(0, "x"), (1, "德州 2025-11-25 数值"), (2, "y"), (3, "z")], "idx int, text string").withColumn("k", F.lit(1))
    kept = with_neighbours(d, any_clause(F.col("text"), clauses), ["k"], ["idx"]).orderBy("idx").collect()
    assert [(r.idx, r.degraded) for r in kept] == [(0, False), (1, False), (2, False)]


def test_many_tables_in_a_batch(spark):
    """Tables are walked many at a time, over batches' borders, not with a call of Python for each."""
    rows = [(i, r, p, f"{i}-{r}-{p}", 1 + (i + r + p) % 3, 1 + (i * r + p) % 2, 3) for i in range(50) for r in range(3) for p in range(2)] + [(None, 0, 0, "none", 1, 2, 2)]
    cells = spark.createDataFrame(rows, "table_idx long, r int, pos int, text string, row_span int, col_span int, n_cols int")
    want = []
    for i in [*range(50), None]:
        own = [x for x in rows if x[0] == i]
        want += [(i, y, x, t) for (y, x), t in layout.spread([(x[1], *x[3:6]) for x in own], max(x[1] for x in own) + 1, own[0][6]).items()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = layout.expand_spans(cells)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_in_scope_routes(spark):
    d = spark.createDataFrame([(1, 1, "德州市", "x"), (1, 2, "北京", "德州"), (1, 3, "上海", "y")], "k int, n int, city string, note string")
    got = rows_in_scope(d, [layout.Clause({"city": ["德州市", "德州"]})], {"city": ["city"]}, ["k"], "n").orderBy("n").collect()
    assert [(r.n, r.route) for r in got] == [(1, "columns"), (2, "row_text")]


def test_instruction_pairs_last_wins(spark):
    d = spark.createDataFrame([(0, "说明\n数值：1\n地区：甲"), (1, "x")], "table_index int, t string")
    r = layout.instruction_pairs(d, "t", ["数值", "区域"], {"地区": "区域"}).collect()
    assert [(x.table_index, x.filter_field, x.filter_value, x.fixed_values) for x in r] == [(0, "区域", "甲", {"数值": "1", "区域": "甲"})]


def test_anchor_backfill(spark):
    rows = [(1, "中国", "湖北"), (1, "中国", "湖南"), (1, "中国", "广东"), (1, "", "一句话，很长"), (2, "a", "p"), (2, "b", "q"), (2, "a", "r")]
    got = layout.anchor_backfill(spark.createDataFrame(rows, "k int, f string, _anchor_text string"), "f", ["k"]).collect()
    assert sorted((r.k, r.f) for r in got) == [(1, ""), (1, "广东"), (1, "湖北"), (1, "湖南"), (2, "a"), (2, "a"), (2, "b")]


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_fuzzy_merge_is_the_greedy_pass(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(12, 60))) for _ in range(12)]
    texts = []
    for _ in range(90):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            s[rng.randrange(len(s))] = rng.choice(["", "z", "ab"])
        texts.append("".join(s))
    texts += ["short", "short"]
    least = 0.9
    d = spark.createDataFrame(list(enumerate(texts)), "record_idx long, t string")
    pairs = {(r.a, r.b) for r in fuzzy.similar_pairs(d, least).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(90), 2) if plain_ratio(texts[i], texts[j]) >= least and min(len(texts[i]), len(texts[j])) >= 10}
    assert pairs == want and len(want) > 50
    leader, taken = {}, set()
    for i in range(90):
        if i not in taken:
            for j in range(i + 1, 90):
                if j not in taken and (i, j) in want:
                    taken.add(j)
                    leader[j] = i
    got = {r.record_idx: r.leader for r in fuzzy.leaders(fuzzy.similar_pairs(d, least)).collect()}
    assert got == leader
    assert fuzzy.fuzzy_merge(d.limit(0), ["t"]).count() == 0


def test_fuzzy_keys_that_many_share(spark):
    """Texts of 50 that share one piece of three: keys of it are narrowed, and no pair is lost by it."""
    rng = random.Random(9)
    texts = sorted({f"who customer 00000{rng.randrange(30):02d}{rng.randrange(99):02d} automobile balance {rng.randrange(3)}{rng.randrange(100):02d} {rng.randrange(100):02d}x" for _ in range(1000)})
    texts = [t + "x" * (50 - len(t)) for t in texts]
    texts += sorted({t[:k] + "#" + t[k + 1 :] for t in texts[:60] for k in [rng.randrange(50)]})
    d = spark.createDataFrame(list(enumerate(texts)), "record_idx long, t string")
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if sum(x != y for x, y in zip(a, b, strict=True)) <= 2 and fuzzy.indel_ratio(a, b) >= 0.98}
    tried = {(r.a, r.b) for r in fuzzy.candidates(d, 0.98, most=20).collect()}
    assert want and want <= tried and len(tried) < len(texts) ** 2 / 10  # half the square before
    assert {(r.a, r.b) for r in fuzzy.distinct_pairs(d, 0.98, most=20).collect()} == want
    # equal records: one comparison, one leader
    again = spark.createDataFrame([(i, "the same words again") for i in range(40)] + [(99, "the same words agains")], "record_idx long, t string")
    assert len(fuzzy.similar_pairs(again, 0.95).collect()) == 41 * 40 // 2
    assert [(r.record_idx, r.merge_count) for r in fuzzy.fuzzy_merge(again, ["t"], 0.95).collect()] == [(0, 41)]


def test_texts_of_bytes_and_files(spark, tmp_path):
    from quire.operators import intake

    for name, data in (("a.txt", "中文é".encode("gb18030")), ("b.txt", "é".encode()), ("c.txt", b"\xef\xbb\xbfx"), ("d.md", b"no"), ("e.txt", b"a\xff")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.text for r in intake.read_files(spark, f"file://{tmp_path}", "*.txt").collect()}
    assert got == {"a.txt": "中文é", "b.txt": "é", "c.txt": "x", "e.txt": "a"}
    assert intake.text_of(None) is None


def test_classes_and_segments(spark):
    from quire.operators import intake

    d = spark.createDataFrame([(0, 0, "pdf", "x"), (1, 0, "pdf", "a\n 3、b"), (0, 2, "txt", "。" * 201), (0, 0, "XLSX", "。"), (None, None, "md", "1.5 x")], "n int, t int, s string, x string")
    got = d.select(intake.classify(F.col("n"), 0, F.col("t"), F.col("s")).alias("k"), intake.segments(F.col("x")).alias("g")).collect()
    assert [r.k for r in got] == ["unstructured", "structured", "structured", "structured", "unstructured"]
    assert [r.g for r in got] == [False, True, True, False, True]


def test_complexity_and_kinds(spark):
    from quire.operators import quality

    f = spark.createDataFrame([(1, 11, "txt"), (2, 6, "pdf"), (3, 10_000, "docx"), (4, 60_000, "pdf"), (5, 1000, "docx"), (5, 1000, "pdf")], "t int, n long, s string")
    got = {r.t: (r.chunks, r.seconds, r.level) for r in quality.complexity(f, "t", "n", "s").collect()}
    assert got == {1: (1, 5, "low"), 2: (1, 5, "low"), 3: (10, 32, "low"), 4: (40, 122, "high"), 5: (1, 5, "low")}
    assert {r.t: r.kind for r in quality.input_kind(f, "t", "s").collect()} == {1: "text", 2: "office", 3: "office", 4: "office", 5: "mixed"}
    rows = [(True, True, False, 0), (True, True, True, 2), (True, False, True, 0), (False, True, False, 1)]
    t = spark.createDataFrame(rows, "use_model boolean, multi_table boolean, homogeneous boolean, n_text_chunks int")
    assert [(r.track, r.stages.count(">") + 1) for r in quality.route(t).collect()] == [("word_multi_parallel", 6), ("semantic_slicing_stack", 6), ("char_slice_or_direct", 4), ("model_disabled", 1)]


def test_series_residue_and_lists(spark):
    from quire.functions import values as V

    text = "a    1\n城市    济南\nName: 152, dtype: object"
    assert one(spark, lambda c: V.series_value(c, "城市"), text) == "济南"
    assert one(spark, lambda c: V.series_value(c, "x"), text) == "济南"
    assert one(spark, lambda c: V.series_value(c, "x"), "Name: plain text") == "Name: plain text"
    assert one(spark, lambda c: V.series_value(c), None) is None
    assert one(spark, lambda c: F.array_join(V.text_list(F.array(c, F.lit(" b "), F.lit(" "))), "|"), None) == "b"


def test_candidate_columns(spark):
    from quire.operators import mapping

    assert mapping.candidate_columns(["城市", "监测时间", "x"], "city", {}) == ["城市"]
    assert mapping.candidate_columns(["a", "监测日期(时)", "Datetime"], "date", {}) == ["监测日期(时)", "Datetime"]
    assert mapping.candidate_columns(["单位名"], "公司", {"公司": ["单位名"]}) == ["单位名"]
    assert mapping.candidate_columns(["x"], "", {}) == []


def test_deep_json_is_flattened_to_the_end(spark):
    j = '{"name": "a", "size": "1"}'
    for i in range(9):
        j = f'{{"k{i}": {j}}}'
    d = spark.createDataFrame([(1, j)], "key long, j string")
    assert [(r.record["name"], r.record["size"]) for r in layout.flatten_records(d, "j", ["name", "size"]).collect()] == [("a", "1")]


def test_search_finds_han_text_and_fills_places(spark):
    from quire.operators import retrieval

    rows = [(0, 0, "text", "甲城空气质量"), (0, 1, "table", "甲城空气质量"), *((i, 0, "text", f"other words {i}") for i in range(1, 9))]
    c = spark.createDataFrame(rows, "doc_id long, idx long, type string, text string")
    q = spark.createDataFrame([("空气质量",), ("nothing",)], "question string")
    got = retrieval.search(c, q, 3).orderBy("question", "rank").collect()
    assert [(r.doc_id, r.idx) for r in got if r.question == "nothing"] == [(0, 0), (0, 1), (1, 0)]
    assert [(r.doc_id, r.idx) for r in got if r.question == "空气质量"][:2] == [(0, 1), (0, 0)] and len(got) == 6
    assert retrieval.search(c.limit(0), q, 3).count() == 0


def test_providers_are_asked_once_and_singly(spark, tmp_path):
    from quire.operators import infer

    log = str(tmp_path / "log")

    def first(ps):
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in ps))
        if any("bad" in p for p in ps):
            raise ValueError("bad prompt")
        return [f"1:{p}" for p in ps]

    c = spark.createDataFrame([(i, 0, "bad" if i == 3 else f"p{i}") for i in range(6)], "doc_id long, chunk_idx int, prompt string").coalesce(1)
    got = {r.doc_id: (r.response, r.provider) for r in infer.with_fallback(c, [("a", first), ("b", lambda ps: [f"2:{p}" for p in ps])]).collect()}
    assert got == {i: (f"1:p{i}", "a") for i in range(6) if i != 3} | {3: ("2:bad", "b")}
    assert open(log).read().split().count("p1") == 2  # in its batch, then singly
