"""Retrieval over chunks: BM25, cosine, fusion and top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import tokens as all_tokens
from ..session import cut

#: Published constants of Okapi BM25 and the share of the mean that a negative idf is raised to.
K1, B, FLOOR = 1.5, 0.75, 0.25
#: Rows of found chunks that are broadcast at most, to fetch their texts.
MOST_BROADCAST = 100_000
BOOST = {"table": 1.2, "formula": 1.1, "code": 1.05}


def frequencies(chunks: DataFrame, tokens=all_tokens) -> DataFrame:
    """(token, df): the chunks that hold each token, counted before the shuffle; the blank token's row has the number of all
    chunks, and in dl the sum of their lengths."""
    t = chunks.select(tokens("text").alias("_t"))
    t = t.select(F.size("_t").alias("dl"), F.explode(F.array_append(F.array_distinct("_t"), F.lit(""))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("token") == "", F.col("dl"))).alias("dl"))


def weights(counts: DataFrame, questions: DataFrame, tokens=all_tokens) -> DataFrame:
    """question, token, times, w, avgdl for the tokens that questions ask for and some chunk holds; negative idf is raised to a
    share of the mean idf of all tokens."""
    size = counts.where("token = ''").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    df = counts.where("token <> ''").select("token", "df").crossJoin(F.broadcast(size))  # one row
    df = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("idf").alias("mean"))
    asked = df.join(F.broadcast(asked_tokens(questions, tokens)), "token").crossJoin(F.broadcast(mean))
    return asked.withColumn("w", F.when(F.col("idf") < 0, FLOOR * F.col("mean")).otherwise(F.col("idf"))).select("token", "question", "times", "w", "avgdl")


def asked_tokens(questions: DataFrame, tokens=all_tokens) -> DataFrame:
    """question, token, times: a bounded few for the questions of one job."""
    return questions.select("question", F.explode(tokens("question")).alias("token")).groupBy("question", "token").agg(F.count("*").alias("times"))


def part_score(times="times", w="w", tf="tf", dl="dl", avgdl="avgdl") -> Column:
    """What one token of a question adds to a chunk's BM25."""
    return F.col(times) * F.col(w) * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col(avgdl)))


def bm25(chunks: DataFrame, questions: DataFrame, tokens=all_tokens, counts: DataFrame | None = None) -> DataFrame:
    """question, keys of chunks (and type, if they have it), bm25: every chunk that holds a question's token. chunks: doc_id, idx,
    text.

    Only document frequencies are shuffled (a row for each token and task); a chunk counts the questions' tokens in its own
    row, if it has any. The questions of one job are a bounded few, and so are their tokens.
    """
    asked = cut(weights(cut(frequencies(chunks, tokens)) if counts is None else counts, questions, tokens))
    keys = ["doc_id", "idx", *[c for c in chunks.columns if c == "type"]]
    t = chunks.select(*keys, tokens("text").alias("_t"))
    held = t.select(*keys, F.size("_t").alias("dl"), F.explode("_t").alias("token")).join(F.broadcast(asked.select("token").distinct()), "token")
    hits = held.groupBy(*keys, "dl", "token").agg(F.count("*").alias("tf")).join(F.broadcast(asked), "token")
    return hits.groupBy("question", *keys).agg(F.sum(part_score()).alias("bm25"))


def search(chunks: DataFrame, questions: DataFrame, k: int = 10, tokens=all_tokens) -> DataFrame:
    """question, doc_id, idx, type, text, score, method, rank: the k best chunks by BM25, scaled to 0..1 within a question over
    all chunks and boosted by type; ties in reading order. Texts are read for the found chunks only."""
    counts = cut(frequencies(chunks, tokens))
    hits = cut(bm25(chunks, questions, tokens, counts))
    return with_texts(ranked_hits(hits, questions, counts.where("token = ''").select(F.col("df").alias("n")), chunks, k), chunks)


def with_texts(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds text to the k best chunks of each question."""
    best = cut(best)
    return chunks.select("doc_id", "idx", "text").join(F.broadcast(best) if best.count() <= MOST_BROADCAST else best, ["doc_id", "idx"])


def ranked_hits(hits: DataFrame, questions: DataFrame, size: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of hits (question, doc_id, idx, type, bm25), a table that was cut; size: n, the number of all chunks.

    Chunks without a hit score as 0 BM25. They are never crossed with the questions: 0 enters the scaling where a question
    has fewer hits than there are chunks, and only the first 2 k chunks of each type can fill places that hits leave; chunks
    are read for that only where some question has fewer than k hits above 0.
    """
    q = questions.select("question").distinct()
    found = hits.groupBy("question").agg(F.count("*").alias("_c"), F.count(F.when(F.col("bm25") > 0, 1)).alias("_above"), F.min("bm25").alias("_lo"), F.max("bm25").alias("_hi"))
    span = cut(q.join(found, "question", "left").crossJoin(F.broadcast(size.select(F.col("n").alias("_n")))))  # a row for each question
    some = F.coalesce("_c", F.lit(0)) < F.col("_n")  # some chunk has no hit
    low = F.when(some, F.least(F.coalesce("_lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_lo"))
    high = F.when(some, F.greatest(F.coalesce("_hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_hi"))
    short = not span.where((F.coalesce("_above", F.lit(0)) < k) & (F.coalesce("_c", F.lit(0)) < F.col("_n"))).isEmpty()
    span = F.broadcast(span.select("question", low.alias("_lo"), high.alias("_hi")))
    scaled = lambda x: F.when(F.col("_hi") - F.col("_lo") < 1e-12, 0.0).otherwise((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    # the boost changes the order of hits, so all hits are ranked
    out = hits.join(span, "question").withColumn("score", scaled(F.col("bm25"))).select("question", "doc_id", "idx", "type", "score")
    if short:
        first = chunks.select("doc_id", "idx", "type").withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("doc_id", "idx"))).where(F.col("_r") <= 2 * k)
        rest = first.drop("_r").crossJoin(span).join(hits.select("question", "doc_id", "idx"), ["question", "doc_id", "idx"], "left_anti").withColumn("score", scaled(F.lit(0.0)))
        out = out.unionByName(rest.select("question", "doc_id", "idx", "type", "score"))
    best = top_k(out.withColumn("score", F.round(F.col("score") * boost("type"), 9)), ["question"], ["doc_id", "idx"], k)
    return best.withColumn("method", F.lit("bm25"))


def dot(a: str, b: str) -> Column:
    """Of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def min_max(scores: DataFrame, column: str, within: list[str], to: str) -> DataFrame:
    """0 to 1 within a question; all 0 where the scores are equal."""
    a = scores.groupBy(*within).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return scores.join(a, within).withColumn(to, F.when(span < 1e-12, 0.0).otherwise((F.col(column) - F.col("_lo")) / span)).drop("_lo", "_hi")


def fuse(scores: DataFrame, vector: str | None, text: str | None, alpha: float = 0.65) -> DataFrame:
    """Adds score and method; one signal alone is used as it is."""
    if vector and text:
        return scores.withColumn("score", alpha * F.col(vector) + (1 - alpha) * F.col(text)).withColumn("method", F.lit("hybrid(vector+bm25)"))
    one = vector or text
    return scores.withColumn("score", F.col(one) if one else F.lit(0.0)).withColumn("method", F.lit("vector" if vector else "bm25" if text else "none"))


def hybrid(near: DataFrame, texts: DataFrame, vector: str, text: str, within: list[str], keys: list[str], alpha: float = 0.65) -> DataFrame:
    """within, keys, both signals, score, method: the full outer join of vector scores and text scores, both 0 to 1 within a
    question. A chunk that one signal lacks has 0 there; a question that has one signal only is scored by it, and its method
    says so. alpha is clamped to 0..1."""
    alpha = min(1.0, max(0.0, alpha))
    on = [*within, *keys]
    both = near.select(*on, vector).join(texts.select(*on, text), on, "full")
    has = near.select(*within).distinct().withColumn("_v", F.lit(True)).join(texts.select(*within).distinct().withColumn("_t", F.lit(True)), within, "full")
    both = both.join(has, within)
    v, t = F.coalesce(vector, F.lit(0.0)), F.coalesce(text, F.lit(0.0))
    score = F.when(F.col("_v") & F.col("_t"), alpha * v + (1 - alpha) * t).when(F.col("_v"), v).otherwise(t)
    method = F.when(F.col("_v") & F.col("_t"), "hybrid(vector+bm25)").when(F.col("_v"), "vector").otherwise("bm25")
    return both.select(*on, vector, text, score.alias("score"), method.alias("method"))


def boost(kind: str) -> Column:
    out = F.lit(1.0)
    for name, by in BOOST.items():
        out = F.when(F.col(kind) == name, by).otherwise(out)
    return out


def top_k(scores: DataFrame, within: list[str], order: list[str], k: int) -> DataFrame:
    """Adds rank; the k best of each question, ties in reading order."""
    w = Window.partitionBy(*within).orderBy(F.desc("score"), *order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def source_list(found: DataFrame, documents: DataFrame, length: int = 200) -> DataFrame:
    """question, rank, source, excerpt, score, method, type of search results."""
    return found.join(documents, "doc_id").select("question", "rank", "source", F.substring(F.trim("text"), 1, length).alias("excerpt"), F.round("score", 3).alias("score"), "method", "type")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, q, a: a user turn with the assistant turn right after it; pairs that are blank on both sides go."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    t = t.where("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.trim("text").alias("q"), F.trim("_text").alias("a"))
    return t.where("q <> '' OR a <> ''")
