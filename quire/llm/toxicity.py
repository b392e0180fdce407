"""Operator 9: toxicity by class-conditional Kneser-Ney models.

Two Kneser-Ney bigram models, of toxic and of ordinary documents, are compared by their length-normalised log-likelihoods. In
each, a pair of words counts once for a document that holds it, less a discount; what the discount takes goes to the word's
continuation estimate (its number of different predecessors in the class, less a discount of 1), and from there to a backoff
that both classes share: for each word the number of documents that hold it, over the whole corpus. So rare expressions are
told by the shared counts. The pairs' discount is a share of the preceding word's count, chosen on the tuning rows: near copies
repeat whole passages, and with a small discount the pairs of a few copies would decide. At 1 the backoff alone is left.

The ratio of a word counts as far as it lies more than `band` nats from its document's reference: what moves all words of a
document alike is its language or topic. The reference is the median of a text's unremarkable words and of eight words at the
corpus's median ratio, which toxic words can't raise. A logistic curve over the length-normalised sums, fitted on labelled
documents that the models haven't seen, gives the score and chooses the discount.

The models are fitted on a bounded sample of labelled rows: at most `most_docs` of each class, and at most `most_tuning` for
the curve, taken in the order of a hash. The shared counts and the scores cover all documents.

Nulls and edge cases: a null or empty text scores what no evidence scores; labels that are null or held twice for one
document count once, the larger one; without labels of both classes every score is the share of toxic labels, or 0; repeated
rows score alike; extra columns pass through, but one named score is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, slices, table, word_hashes

_START = np.uint64(0x1234567890ABCDEF)
_ODD = np.uint64(0xA24BAED4963EE407)
#: Documents that a pair's discount takes at least, and documents of each class in which a word must precede others for its pairs
#: to count.
LEAST, SUPPORT = 2.0, 30
#: Words of the base that each text's reference counts besides its own, so that short texts are measured against the corpus.
PRIOR = 8


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * _ODD + words, 9)


def _before(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(words)
    if len(words):
        out[1:] = words[:-1]
        out[at[:-1][at[:-1] < len(words)]] = _START
    return out


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample_labels(labels: DataFrame, most_docs: int, most_tuning: int) -> DataFrame:
    """(doc_id, toxic, tuning) of the labelled rows used: bounded, in hash order."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(fold_of(F.col("doc_id")) != 0).withColumn("_h", F.xxhash64("doc_id"))
    own = own.withColumn("tuning", F.pmod("_h", F.lit(3)) == 0)
    parts = [own.where(f"not tuning and toxic = {c}").orderBy("_h", "doc_id").limit(most_docs) for c in (0, 1)]
    parts.append(own.where("tuning").orderBy("_h", "doc_id").limit(most_tuning))
    return parts[0].union(parts[1]).union(parts[2]).drop("_h")


def shared_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the number of documents that hold each word, over all documents."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                own = [np.zeros(0, np.uint64)]
                for sub in slices(part):
                    words, at = word_hashes(sub.column("text"))
                    if len(words):
                        doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
                        # distinct in each document: sort by a hash of both, then take the words back
                        _, first = np.unique(mix(words + doc * _ODD, 8), return_index=True)
                        own.append(words[first])
                word, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(sample: DataFrame) -> DataFrame:
    """(toxic, before, word, n): the documents of each class that hold a pair of words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, at = word_hashes(part.column("text"))
                before, n = _before(words, at), np.diff(at)
                toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32), n)
                doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                _, first = np.unique(mix(_pair(before, words) + doc * _ODD, 8), return_index=True)  # once for a document
                cols = [pa.array(toxic[first]), pa.array(before[first].view(np.int64)), pa.array(words[first].view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["toxic", "before", "word"])

    found = sample.select("text", "toxic").mapInArrow(run, "toxic int, before long, word long")
    return found.groupBy("toxic", "before", "word").agg(F.count("*").alias("n"))


class Pairs:
    """Discounted shares of word pairs, and what is left of each preceding word's share, in both classes. The discount is a
    share of the preceding word's count, `LEAST` documents at least."""

    def __init__(self, pairs, discount: float):
        less = np.maximum(pairs["total"].to_numpy(float) * discount, LEAST)
        kept, less = pairs[pairs["n"] > less], less[pairs["n"] > less]
        before, word, c = (kept[k].to_numpy(np.int64) for k in ("before", "word", "toxic"))
        share = (kept["n"].to_numpy(float) - less) / kept["total"].to_numpy(float)
        hashes = _pair(before.view(np.uint64), word.view(np.uint64))
        self.pairs, at = np.unique(hashes, return_inverse=True)
        self.shares = np.zeros((len(self.pairs) + 1, 2))  # the last row is for pairs that aren't kept
        self.shares[at, c] = share
        self.before, at = np.unique(before.view(np.uint64), return_inverse=True)
        self.left = np.ones((len(self.before) + 1, 2))
        np.subtract.at(self.left, (at, c), share)

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, at, len(keys))

    def estimates(self, before: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Both classes' estimates of words after `before`, given those without it."""
        return self.shares[self._find(self.pairs, _pair(before, words))] + self.left[self._find(self.before, before)] * lower


class Model:
    """Words' hashes in order, both classes' estimates, and the curve's parameters."""

    def __init__(self, words, shared: dict[int, float], pairs: Pairs, band: float, discount: float = 1.0):
        self.curve, self.band, self.pairs = np.zeros(3), band, pairs
        hashes = words["word"].to_numpy(np.int64).view(np.uint64)
        self.words = np.unique(hashes)
        self.known = np.zeros((len(self.words), 2))
        left = [1.0, 1.0]
        for c in (0, 1):
            own = (words["toxic"] == c).to_numpy()
            p = np.maximum(words["n"].to_numpy(float)[own] - discount, 0) / words["total"].to_numpy(float)[own]
            self.known[np.searchsorted(self.words, hashes[own]), c] = p
            left[c] = 1 - p.sum()
        self.known += np.outer([shared[int(w)] for w in self.words.view(np.int64)], left)
        self.known = np.vstack((self.known, left))  # words that neither class knows: the shared part cancels
        self.ratio = np.log(self.known[:, 1]) - np.log(self.known[:, 0])
        mass = np.array([shared[int(w)] for w in self.words.view(np.int64)])
        mass = np.append(mass, max(0.0, 1 - mass.sum()))
        order = np.argsort(self.ratio, kind="stable")
        self.base = float(self.ratio[order[np.searchsorted(np.cumsum(mass[order]), mass.sum() / 2)]])

    def reference(self, ratio: np.ndarray) -> float:
        """The median of a text's unremarkable words and PRIOR words of the base. None above the base moves it up."""
        plain = ratio[np.abs(ratio - self.base) <= self.band]
        return float(np.median(np.append(np.minimum(plain, self.base), np.full(PRIOR, self.base))))

    def evidence(self, column: pa.Array) -> np.ndarray:
        """For each text the summed log-likelihood ratio by the square root of its length, and by its length, on log scales."""
        words, at = word_hashes(column)
        out = np.zeros((len(at) - 1, 2))
        if len(words):
            where = Pairs._find(self.words, words)
            p = self.pairs.estimates(_before(words, at), words, self.known[where])
            ratio = np.log(p[:, 1]) - np.log(p[:, 0])
            for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if e > s:
                    r = ratio[s:e] - self.reference(ratio[s:e])
                    total = (r - np.clip(r, -self.band, self.band)).sum()
                    out[i] = 4 * total / np.sqrt(e - s), 40 * total / (e - s)
        return np.sign(out) * np.log1p(np.abs(out))

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.evidence(column) @ self.curve[:2] + self.curve[2]
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def tune(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> float:
        """Logistic regression by Newton's steps; returns its loss."""
        scale = np.maximum(np.abs(x).mean(0), 1e-9)
        z = np.column_stack((x / scale, np.ones(len(x))))
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * w
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(3), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w / np.append(scale, 1)
        p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 2000, most_tuning: int = 6000, discounts: tuple[float, ...] = (0.05, 0.15, 0.4, 1.0), band: float = 2.0) -> Model | float:
    """The model, or the share of toxic labels where only one class has labels."""
    chosen = sample_labels(labels, most_docs, most_tuning)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    have = {(bool(r[0]), int(r[1])): r[2] for r in sample.groupBy("tuning", "toxic").count().collect()}
    if not all(have.get((t, c)) for t in (False, True) for c in (0, 1)):
        n = sum(have.values())
        return sum(v for k, v in have.items() if k[1]) / n if n else 0.0
    pairs = cut(_bigrams(sample.where("not tuning")))
    words = pairs.groupBy("toxic", "word").agg(F.count("*").alias("n"))  # different words before it
    sums = pairs.groupBy("toxic").agg(F.count("*").alias("total"))
    words = cut(words.where("n > 1").join(F.broadcast(sums), "toxic"))
    totals = pairs.groupBy("before").pivot("toxic", [0, 1]).agg(F.sum("n")).where(F.least("0", "1") >= SUPPORT)
    frequent = pairs.where(F.col("n") > LEAST).join(totals, "before").withColumn("total", F.when(F.col("toxic") == 1, F.col("1")).otherwise(F.col("0")))
    frequent = frequent.select("toxic", "before", "word", "n", "total").toPandas()  # bounded by the sample
    counts = cut(shared_counts(docs))
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    known = counts.join(F.broadcast(words.select("word").distinct()), "word").toPandas()  # bounded by the sample
    shared = dict(zip(known["word"].tolist(), ((known["n"] + 1) / (total + kinds)).tolist(), strict=True))
    words = words.toPandas()
    models = [Model(words, shared, Pairs(frequent, d), band) for d in discounts]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = np.hstack([m.evidence(part.column("text")) for m in models])
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("toxic")], ["x", "toxic"])

    seen = sample.where("tuning").select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toPandas()
    x, y = np.stack(seen["x"].to_numpy()), seen["toxic"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # rows come in any order
    losses = [m.tune(x[order, 2 * i : 2 * i + 2], y[order]) for i, m in enumerate(models)]
    return models[int(np.argmin(losses))]


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs with score."""
    docs = docs.drop("score")
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.score(part.column("text")))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, f"{fields}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    return score(docs, fit(docs, labels, **sizes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
