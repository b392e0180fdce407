"""Records that arrive late, twice, or after their key was done, against the batch merge of each key's sessions."""

import datetime

from quire.operators import records as R
from quire.streaming.merging import merged_arrivals

START = datetime.datetime(2024, 1, 1)
SCHEMA = "record_idx long, name string, a string, b string, ts timestamp"


def row(i, name, a, b, minutes):
    return (i, name, a, b, START + datetime.timedelta(minutes=minutes))


BATCHES = [
    [row(1, "x", "aa", "", 0), row(2, " x ", "bbb", None, 5), row(3, "y", "y", "q", 6), row(2, "x", "bbb", None, 5)],
    [row(4, "x", "ccc", "long", 20), row(1, "x", "aa", "", 0), row(5, "z", " z ", "1", 21)],  # 1 comes again
    [row(6, "z", "zz", "2", 200)],  # x, y and z are done when this has passed; 6 opens z again
    [row(7, "x", "late", "late", 30), row(8, "x", "new", "n", 205), row(9, "w", "w", "w", 206)],
    [row(10, "end", "", "", 5000)],
    [row(11, "end", "", "", 5001)],
]
#: Rows of each key's sessions, without replays and late rows.
SESSIONS = [[1, 2, 4], [3], [5], [6], [8], [9]]


def test_stream_equals_batch(spark, tmp_path):
    seen = {}
    for n, batch in enumerate(BATCHES):
        df = spark.createDataFrame(batch, SCHEMA)
        seen.update({r.record_idx: r for r in df.collect()})
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = merged_arrivals(stream, ["name"], ["a", "b"], idle="1 hour", late="10 minutes", grace="30 days")
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    late = sorted((r.record_idx, r.name, r.a) for r in rows if r.kind == "late")
    assert late == [(7, "x", "late")]
    want = []
    for ids in SESSIONS:
        one = R.merge_by_key(spark.createDataFrame([seen[i] for i in ids], SCHEMA), ["name"], ["a", "b"]).first()
        want.append((seen[ids[0]].name.strip(), one.record_idx, one.merge_count, one.a, one.b))
    got = [(r.name, r.record_idx, r.merge_count, r.a, r.b) for r in rows if r.kind == "record" and r.name != "end"]
    assert sorted(got, key=repr) == sorted(want, key=repr)
