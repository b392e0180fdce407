"""Internal names that a table may have itself, and permutations over whole ranges."""

from pyspark.sql import functions as F

from quire.llm import mixing, pseudonyms


def test_columns_of_internal_names_stay(spark):
    names = ["_size", "_draw", "_range", "_part", "_whole", "_rest", "_cut", "_from", "_at", "_s", "_all", "_source", "_n"]
    docs = spark.createDataFrame([(i, f"a b c {i}", "s") for i in range(5)], "doc_id long, text string, source string").selectExpr("*", *[f"doc_id AS {n}" for n in names])
    for out in (mixing.mix(docs), pseudonyms.pseudonymise(docs)):
        rows = out.collect()
        assert len(rows) == 5 and all(r[n] == r.doc_id for r in rows for n in names)


def test_all_days_are_permuted(spark):
    days = spark.range(pseudonyms._DAYS).select("id", F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select("d", pseudonyms.date(F.col("d"), "quire").alias("m"))
    r = moved.agg(F.countDistinct("m").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.count_if(F.col("m") == F.col("d")).alias("same")).first()
    assert (r.n, r.lo, r.hi) == (pseudonyms._DAYS, "1900-01-01", "2099-12-31") and r.same < 10


def test_addresses_are_linked_in_either_case(spark):
    rows = spark.createDataFrame([("jo.doe9@x.com",), ("JO.Doe9@x.com",), ("Jo.doe9@X.com",)], "t string").select(pseudonyms.email(F.col("t"), "quire").alias("m")).collect()
    assert len({r.m.lower() for r in rows}) == 1 and rows[0].m != "jo.doe9@x.com"
    assert rows[1].m[:2].isupper() and rows[1].m[3].isupper() and rows[1].m[4:6].islower()
