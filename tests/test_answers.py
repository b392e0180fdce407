"""Model answers to records: repairs and rejects."""

import json

import pytest

from quire.operators import answers

CASES = [
    ('{"a":1}', ['{"a":1}']),
    ('```json\n{"a":1}\n```', ['{"a":1}']),
    ('{"records":[{"a":1},{"a":2', ['{"records":[{"a":1},{"a":2}]}']),
    ('{"a": {"b": [1, {"c": "d', ['{"a":{"b":[1,{"c":"d"}]}}']),
    ("{a: 1}", ['{"a":1}']),
    ('Here: {"a":1} thanks', ['{"a":1}']),
    ('see [1]: {"a":2}', ["[1]", '{"a":2}']),
    ('{"a":1}\n\n {"a":2}\n[3]', ['{"a":1}', '{"a":2}', "[3]"]),
    ('{"a": 3278万人, "b": 37.5%, c: True, d: -1.5e3, e: 007}', ['{"a":"3278万人","b":"37.5%","c":true,"d":-1.5e3,"e":"007"}']),
    ('{脱贫人口: 3 万 人, "b": no "quotes}', [None]),
    ('[{"a":1,},{"a":2},,]', ['[{"a":1},{"a":2}]']),
    ('{"a":"x\ny\tz"}', ['{"a":"x\\ny\\tz"}']),
    ('{"a":"tru', ['{"a":"tru"}']),
    ('{"a":"x\\', ['{"a":"x"}']),
    ('{"a":"x\\u00', ['{"a":"x"}']),
    ('{"a":1,"b', ['{"a":1}']),
    ('{"a":1,"b":', ['{"a":1,"b":null}']),
    ('{"a":, "b":2}', ['{"a":null,"b":2}']),
    ('{"a":[1,2}', ['{"a":[1,2]}']),
    ('{"a":[[1,{"b":2]}', ['{"a":[[1,{"b":2}]]}']),
    ('{"a":1]}', ['{"a":1}']),
    ('} ] {"a":1}} ]', ['{"a":1}']),
    ("{'a': 'it\\'s', 'b': None, c: 'say \"x\"'}", ['{"a":"it\'s","b":null,"c":"say \\"x\\""}']),
    ('{"a":"br{ac[ket, ]}: \\"x\\\\"} tail }', ['{"a":"br{ac[ket, ]}: \\"x\\\\"}']),
    ('{"a" 1}', [None]),
    ("none here", []),
    ("", []),
    (None, None),
]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", answers.json_values("t").alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text
        for v in got[i] or []:
            assert v is None or json.loads(v) is not None


def test_sound_answers_stay(spark):
    """Any JSON that a library writes comes back with the same value."""
    values = [{"k": [1, 2.5, None, True, {"x": "a\"b\\c\n{[,:]}'"}], "": "é漢"}, [[], {}, [{}]], {"a": {"b": {"c": [{"d": []}]}}}, {"t": "```json {", "u": "\u0001  "}]
    df = spark.createDataFrame([(i, json.dumps(v, indent=n, ensure_ascii=e)) for i, v in enumerate(values) for n in (None, 2) for e in (True, False)], "i int, t string")
    rows = df.select("i", answers.json_values("t").alias("v")).collect()
    assert len(rows) == 16
    for r in rows:
        assert [json.loads(v) for v in r.v] == [values[r.i]]


def test_cut_anywhere(spark):
    """Each beginning of a nested answer is mended, and nothing that was there before the cut is lost."""
    whole = '{"records": [{"name": "A \\"b\\"", "tags": ["x", "y"]}, {"name": "C", "n": {"u": 1.5}}], "total": 2}'
    df = spark.createDataFrame([(n, whole[:n]) for n in range(1, len(whole) + 1)], "n int, t string")
    got = {r.n: r.v for r in df.select("n", answers.json_values("t").alias("v")).collect()}
    for n, v in got.items():
        assert len(v) == 1 and v[0] is not None, whole[:n]
        assert len(json.loads(v[0]).get("records") or []) >= whole[:n].count('"name": "') - 0
    assert json.loads(got[len(whole)][0]) == json.loads(whole)


@pytest.mark.parametrize("rows", [[], None])
def test_records_and_rejects(spark, rows):
    cases = [(1, '{"records": [{"a": 1}, 5, {"a": 2}]}'), (2, "[1, 2]"), (3, None), (4, "no"), (5, '{"a" 1}'), (6, '{"a": 3}\n{"a" 4}'), (6, '{"a": 3}\n{"a" 4}'), (7, '[{"b": 1}]')]
    df = spark.createDataFrame(cases if rows is None else rows, "pos int, t string").selectExpr("pos AS id", "t", "'x' AS record_")
    good, bad = answers.records(df, "t", "a int")
    if rows == []:
        assert good.count() == bad.count() == 0
        return
    assert sorted((r.id, r.pos, r.record.a) for r in good.where("id < 7").collect()) == [(1, 0, 1), (1, 1, 2), (6, 0, 3), (6, 0, 3)]
    assert [r.record.a for r in good.where("id = 7").collect()] == [None]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(2, "no record"), (3, "no answer"), (4, "no JSON"), (5, "broken"), (6, "broken"), (6, "broken")]
    assert bad.columns == ["id", "record_", "t", "reason"]
