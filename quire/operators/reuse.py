"""Reuse of earlier results by content: a table of results under the hash of what they were computed from.

`<path>/results` is partitioned by batch and by the hash's first two digits; `<path>/commits`, written last, names the batches
that are whole, so that a run that failed leaves nothing that is read and its repetition computes the same keys again. A run
reads the keys of its own inputs' partitions only, computes what none of them holds, once for equal contents, and gives
every input row its result.

Nulls and edge cases: null content is a content of its own; rows of equal content share a result; an empty input commits
nothing; columns named `key` and `_hash` are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def content_key(*columns: str) -> F.Column:
    """sha256 of columns; nulls differ from empty texts, and no shift of text between columns gives an equal key."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """key, the results' columns, prefix and batch of all committed batches."""
    shape = f"key string, {schema}, batch string, prefix string"
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], shape)
    batches = [r.batch for r in spark.read.parquet(f"{path}/commits").collect()]  # a row for each run
    paths = [f"{path}/results/batch={b}" for b in batches]
    return spark.read.schema(shape).option("basePath", f"{path}/results").parquet(*paths)


def reused(inputs: DataFrame, content: list[str], compute: Callable[[DataFrame], DataFrame], schema: str, path: str) -> tuple[DataFrame, int]:
    """(inputs with the columns of `schema`, how many contents were computed). compute maps (key, content columns) to (key,
    columns of `schema`), a row for each key."""
    spark = inputs.sparkSession
    keyed = inputs.drop("key", "_hash").withColumn("key", content_key(*content))
    wanted = keyed.groupBy("key").agg(*[F.first(c).alias(c) for c in content]).withColumn("prefix", F.substring("key", 1, 2))
    done = stored(spark, path, schema)
    prefixes = [r.prefix for r in wanted.select("prefix").distinct().collect()]  # 256 at most
    todo = wanted.join(done.where(F.col("prefix").isin(prefixes)).select("key"), "key", "left_anti") if prefixes else wanted
    todo = cut(todo.drop("prefix"))
    n = todo.count()
    if n:
        batch = uuid.uuid4().hex
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        fresh = compute(todo).select("key", *names).withColumn("prefix", F.substring("key", 1, 2))
        fresh.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/results/batch={batch}")
        spark.createDataFrame([(batch, n)], "batch string, n long").coalesce(1).write.mode("append").parquet(f"{path}/commits")
        done = stored(spark, path, schema)
    return keyed.join(done.drop("prefix", "batch"), "key", "left").drop("key"), n
