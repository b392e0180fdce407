"""A stored inverted index for BM25 search: posting blocks in token buckets, with block maxima that let a search skip blocks.

A folder holds Parquet tables, all but the last under `batch=<n>`, one batch for each append:

- blocks, also under `bucket=<b>` (a hash of the token): token, segment, block, n, most_tf, least_dl, postings. A segment is a
  share of a batch's documents, so that no group has more postings of a token than a segment has chunks; its postings of a
  token, the strongest first, are cut into blocks.
- tokens, under the same buckets: token, df.
- heads: the first chunks of each type, which fill places that hits leave.
- stats, written last: batch, n, dl, mean. A batch that stats doesn't name isn't there, so an append that failed leaves no trace
  in searches and is simply repeated.

A search reads the buckets of its questions' tokens only (partition filters), computes a floor for the k-th score from the
strongest blocks, and opens a block only where its own maximum with those of the question's other tokens can reach the floor.
Scores, order and ties are those of retrieval.search. The exact way for the rest: where common tokens could leave no chunk
without a hit, all blocks of the question are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import tokens as all_tokens
from ..session import cut
from . import retrieval
from .retrieval import B, BOOST, K1

BUCKETS, SEGMENT, BLOCK = 64, 20_000, 128
#: First chunks of each type that a batch keeps; searches for more than half as many read the chunks.
HEADS = 64
#: Strongest blocks of each token that give the floor.
FIRST_BLOCKS = 2
#: Different tokens of one job's questions.
MOST_TOKENS = 10_000


SCHEMAS = {
    "blocks": "token string, segment int, block int, n int, most_tf int, least_dl int, postings array<struct<doc_id: long, idx: long, type: string, tf: int, dl: int>>, batch int, bucket int",
    "tokens": "token string, df long, batch int, bucket int",
    "heads": "doc_id long, idx long, type string, batch int",
}


def _bucket(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append(chunks: DataFrame, path: str, tokens=all_tokens) -> int:
    """Add chunks (doc_id, idx, type, text) that the index doesn't hold yet; gives the batch's number."""
    spark = chunks.sparkSession
    before = stats(spark, path).first() if _exists(spark, f"{path}/stats") else None
    batch = before.batch + 1 if before else 0
    t = chunks.select("doc_id", "idx", "type", tokens("text").alias("_t"))
    size = t.agg(F.count("_t").alias("n"), F.coalesce(F.sum(F.size("_t")), F.lit(0)).alias("dl")).first()
    segments = -(-size.n // SEGMENT) or 1
    held = t.select("doc_id", "idx", "type", F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    held = held.groupBy("doc_id", "idx", "type", "dl", "token").agg(F.count("*").cast("int").alias("tf"))
    held = held.withColumn("segment", F.pmod(F.xxhash64("doc_id", "idx"), F.lit(segments)).cast("int"))
    # the strongest first, whatever the mean length: more often, then in a shorter chunk
    posting = F.struct((-F.col("tf")).alias("less"), "dl", "doc_id", "idx", "type")
    lists = held.groupBy("token", "segment").agg(F.array_sort(F.collect_list(posting)).alias("p"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(BLOCK)), lambda i: F.slice("p", i, BLOCK))
    blocks = lists.select("token", "segment", F.posexplode(cuts).alias("block", "p"))  # at least one posting
    postings = F.transform("p", lambda x: F.struct(x["doc_id"], x["idx"], x["type"], (-x["less"]).alias("tf"), x["dl"]))
    blocks = blocks.select(_bucket("token").alias("bucket"), "token", "segment", "block", F.size("p").alias("n"), (-F.array_min(F.transform("p", lambda x: x["less"]))).alias("most_tf"), F.array_min(F.transform("p", lambda x: x["dl"])).alias("least_dl"), postings.alias("postings"))
    blocks = blocks.repartitionByRange("bucket", "token", "segment").sortWithinPartitions("bucket", "token", "segment", "block")
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/batch={batch}")
    df = _read(spark, path, "blocks", batch + 1, None).where(F.col("batch") == batch)
    df = df.groupBy("bucket", "token").agg(F.sum("n").alias("df")).sortWithinPartitions("bucket", "token")
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tokens/batch={batch}")
    w = Window.partitionBy("type").orderBy("doc_id", "idx")
    heads = chunks.select("doc_id", "idx", "type").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= HEADS).drop("_r")
    heads.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")
    n, dl = size.n + (before.n if before else 0), size.dl + (before.dl if before else 0)
    all_df = _read(spark, path, "tokens", batch + 1, None).groupBy("token").agg(F.sum("df").alias("df"))
    mean = all_df.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
    row = spark.createDataFrame([(batch, n, dl, mean)], "batch int, n long, dl long, mean double")
    row.coalesce(1).write.mode("append").parquet(f"{path}/stats")
    return batch


def stats(spark: SparkSession, path: str) -> DataFrame:
    """batch, n, dl, mean of the last append: one row."""
    return spark.read.parquet(f"{path}/stats").orderBy(F.desc("batch")).limit(1)


def _read(spark: SparkSession, path: str, table: str, batches: int, asked: list[str] | None) -> DataFrame:
    df = spark.read.schema(SCHEMAS[table]).option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={b}" for b in range(batches)])
    if asked is None:
        return df
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in asked], "token string").select(_bucket("token")).distinct().collect()]
    return df.where(F.col("bucket").isin(buckets) & F.col("token").isin(asked))


def _score(tf: str, dl: str) -> F.Column:
    return retrieval.part_score(tf=tf, dl=dl)


def planned(spark: SparkSession, path: str, questions: DataFrame, k: int, tokens=all_tokens, skip: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks, size): the blocks that a search opens, with question, times, w, avgdl, and one row with n."""
    found = stats(spark, path).first()
    q = retrieval.asked_tokens(questions, tokens)
    some = q.select("token").distinct().limit(MOST_TOKENS + 1).collect()  # the tokens of one job's questions
    asked = [r.token for r in some] if len(some) <= MOST_TOKENS else None
    df = _read(spark, path, "tokens", found.batch + 1, asked).groupBy("token").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(found.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    w = df.withColumn("_idf", idf).select("token", "df", F.when(F.col("_idf") < 0, retrieval.FLOOR * F.lit(found.mean)).otherwise(F.col("_idf")).alias("w"))
    w = cut(q.join(w, "token").withColumn("avgdl", F.lit(found.dl / found.n if found.n else 0.0)))  # a row for each question and token
    blocks = _read(spark, path, "blocks", found.batch + 1, asked).join(F.broadcast(w) if asked is not None else w, "token")
    size = spark.createDataFrame([(found.n,)], "n long")
    if not skip:
        return blocks, size
    keys = ["question", "token", "batch", "segment", "block"]
    bound = blocks.select(*keys, "times", "w", "avgdl", "df", _score("most_tf", "least_dl").alias("bound"))
    bound = cut(bound)  # a row for each block: its maximum, without its postings
    strongest = Window.partitionBy("question", "token").orderBy(F.desc("bound"), "batch", "segment", "block")
    first = bound.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= FIRST_BLOCKS).select(*keys)
    least = _opened(blocks.join(F.broadcast(first), keys)).groupBy("question").agg(F.sort_array(F.collect_list("bm25"), False).alias("s"))  # of FIRST_BLOCKS blocks a token
    least = least.select("question", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(0.0)).alias("floor"))
    top = bound.groupBy("question", "token").agg(F.max("bound").alias("most"), F.first("df").alias("df"), F.first("w").alias("w"))
    # all chunks may have a hit, or hits may lower a score: nothing is skipped then
    whole = (F.sum("df").over(Window.partitionBy("question")) >= found.n) | (F.min("w").over(Window.partitionBy("question")) < 0)
    top = top.select("question", "token", (F.sum("most").over(Window.partitionBy("question")) - F.col("most")).alias("others"), whole.alias("whole"))
    kept = bound.join(F.broadcast(top), ["question", "token"]).join(F.broadcast(least), "question")  # rows for each question and token
    kept = kept.where(F.col("whole") | (F.col("bound") + F.col("others") >= F.col("floor") / max(BOOST.values()) * (1 - 1e-6)))
    return blocks.join(kept.select(*keys), keys, "left_semi"), size


def _opened(blocks: DataFrame) -> DataFrame:
    """question, doc_id, idx, type, bm25 from blocks with their weights."""
    p = blocks.select("question", "times", "w", "avgdl", F.explode("postings").alias("p")).select("question", "times", "w", "avgdl", "p.*")
    return p.groupBy("question", "doc_id", "idx", "type").agg(F.sum(_score("tf", "dl")).alias("bm25"))


def search(path: str, questions: DataFrame, chunks: DataFrame, k: int = 10, tokens=all_tokens, skip: bool = True) -> DataFrame:
    """As retrieval.search, from the index at `path`; chunks are read for the texts of what was found."""
    spark = questions.sparkSession
    blocks, size = planned(spark, path, questions, k, tokens, skip)
    last = stats(spark, path).first().batch
    heads = chunks if 2 * k > HEADS else _read(spark, path, "heads", last + 1, None)
    return retrieval.with_texts(retrieval.ranked_hits(cut(_opened(blocks)), questions, size, heads, k), chunks)
