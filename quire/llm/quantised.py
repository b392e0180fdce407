"""Operator 3: near-duplicate embeddings by product quantisation.

Coarse centroids, and finer ones of the residuals where a label is large, give inverted lists within each label; a list holds
residual codes, one byte for each subspace. A vector probes its own list and every list whose bisecting plane is near enough
for a linked vector to lie behind it; distances come from lookup tables (asymmetric: exact query, coded entry), and an
entry's stored coding error makes the table test lossless; what is left is reranked by exact cosine in double precision.
Lists are dealt in blocks, each block of a list against each block of its queries, so that a hot label is many tasks. A pair
counts for both ends, also where only one of them probes the other's list.

Centroids and codebooks are fitted on a bounded sample (`most_sample` vectors in the order of a hash); every vector is
indexed and every vector is a query. Lists grow in number with the largest label, up to 1,024 coarse ones times 256 finer ones.
`margin` is the share of the link radius that a probe covers: 1 loses nothing by geometry. Its default comes from the data:
`DEVIATIONS` standard deviations of a displacement in as many dimensions as the sample's residuals spread over, so that it is
1 up to some 16 dimensions (recall is tested from 4 to 256).

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label, link
with nothing; vectors link within one length only; equal vectors are one entry with a count; repeated vec_ids are taken as
one vector; labels may be of any type; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import connected_components

BLOCK = 4096
#: Pairs whose vectors a task holds at once for the exact cosine.
PAIRS = 1 << 15
DEVIATIONS = 4.0
MOST_LISTS, MOST_FINER = 1024, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample; an empty centroid keeps its place."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = [distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]
    return np.concatenate(out) if out else np.zeros(0, np.int64), c


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, finer: int = 1, parts: int = 8, codes: int = 256):
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse)[0]]
        self.finer = kmeans(residual, finer)
        spread = np.linalg.eigvalsh(residual.T @ residual)
        self.dimensions = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)) if spread.sum() > 1e-9 else 1.0
        self.cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(residual[:, a:b], codes, 5) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each vector's list."""
        at = nearest(x, self.coarse)[0]
        return at * len(self.finer) + nearest(x - self.coarse[at], self.finer)[0]

    def code(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the coding errors."""
        r = x - self.coarse[at // len(self.finer)]
        codes = np.stack([nearest(r[:, a:b], c)[0] for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.books)], 1)
        return codes, np.sqrt(((r - back) ** 2).sum(1))

    @staticmethod
    def _near(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(i, c): row i's nearest centroid, and others whose bisecting plane with it is within `reach` of the row."""
        d = distances(x, centroids)
        own, all_of = d.argmin(1), np.arange(len(d))
        apart = np.sqrt(distances(centroids, centroids))[own]
        gap = (d - d[all_of, own][:, None]) / np.maximum(2 * apart, 1e-12)
        gap[all_of, own] = 0
        return np.nonzero(gap <= reach)

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists that can hold a vector within `reach` of x in the direction of their centroid."""
        out = []
        for s in range(0, len(x), 256):
            v = x[s : s + 256]
            i, c = self._near(v, self.coarse, reach)
            if len(self.finer) > 1:
                j, f = self._near(v[i] - self.coarse[c], self.finer, reach)
                i, c = i[j], c[j] * len(self.finer) + f
            out += np.split(c.astype(np.int32), np.cumsum(np.bincount(i, minlength=len(v)))[:-1])
        return out

    def tables(self, q: np.ndarray, at: int) -> list[np.ndarray]:
        r = q - self.coarse[at // len(self.finer)]
        return [distances(r[:, a:b], c) for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _raw(batches):
    """(…, raw) with the components as doubles."""
    for batch in batches:
        raw = [np.array(v, "<f8").tobytes() for v in batch.column("embedding").to_pylist()]
        yield batch.drop_columns(["embedding"]).append_column("raw", pa.array(raw, pa.binary()))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable vectors with their class's key, and one row for each class of equal vectors: vec_id (smallest), many, raw. grp is
    the label with the vector's length; shorter vectors are filled up with zeros, which changes no cosine."""
    e = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good &= ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    v = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.concat_ws(":", F.size("embedding"), F.col("label").cast("string")).alias("grp"), e.alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
    v = v.where("good").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    v = v.where(F.exists("embedding", lambda x: x != 0)).drop("good")
    v = cut(v.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}))
    longest = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    one = v.groupBy("grp", "k1", "k2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"), F.countDistinct("vec_id").alias("many"))
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("embedding")))
    one = one.select("grp", "vec_id", "many", filled.alias("embedding")).mapInArrow(_raw, "grp string, vec_id long, many long, raw binary")
    return v.select("vec_id", "grp", "k1", "k2").distinct(), cut(one)


def links(one: DataFrame, least: float, margin: float | None, most_sample: int, list_size: int) -> DataFrame:
    """(id, n, to): links counted for id in one block, and the smallest id that block's links join it to."""
    largest = one.groupBy("grp").count().agg(F.max("count")).first()[0]
    if not largest:
        return one.sparkSession.createDataFrame([], "id long, n long, to long")
    sample = unit([bytes(r[0]) for r in one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_sample).select("raw").collect()])
    lists = -(-largest // list_size)
    q = Quantiser(sample, max(1, min(MOST_LISTS, lists)), max(1, min(MOST_FINER, lists // MOST_LISTS)))
    radius = float(np.sqrt(2 - 2 * least))
    reach = radius * (min(1.0, DEVIATIONS / np.sqrt(q.dimensions)) if margin is None else margin) + 1e-9

    def index(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = unit(part.column("raw").to_pylist())
                at = q.place(x)
                codes, error = q.code(x, at)
                cols = [pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(q.probes(x, reach), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, "list", "codes", "error", "probes"])

    indexed = cut(one.mapInArrow(index, "grp string, vec_id long, many long, raw binary, list int, codes binary, error double, probes array<int>"))
    blocks = indexed.groupBy("grp", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col("blocks").cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    entries = indexed.join(blocks, ["grp", "list"]).withColumn("block", block(1))
    entries = entries.select("grp", "list", "block", every.alias("q_block"), "vec_id", "many", "raw", "codes", "error", "probes")
    asks = indexed.select("grp", F.col("list").alias("own"), F.explode("probes").alias("list"), "vec_id", "many", "raw").join(blocks, ["grp", "list"]).withColumn("q_block", block(2))
    asks = asks.select(*[F.col(c).alias(c) for c in ("grp", "list", "q_block", "vec_id", "many", "own", "raw")], every.alias("block"))

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        found_n, found_id, found_to = [], [], []
        if asked.num_rows and held.num_rows:
            at = held.column("list")[0].as_py()
            x, ids, many = unit(held.column("raw").to_pylist()), held.column("vec_id").to_numpy(), held.column("many").to_numpy()
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            bound = (radius + held.column("error").to_numpy() + 1e-6) ** 2
            q_ids, q_many, q_own = (asked.column(c).to_numpy() for c in ("vec_id", "many", "own"))
            probes = held.column("probes").combine_chunks()
            probed = np.repeat(np.arange(len(ids)), np.diff(probes.offsets.to_numpy())) << 32 | probes.flatten().to_numpy()  # sorted
            n, back, left, right = np.zeros(len(q_ids), np.int64), np.zeros(len(ids), np.int64), [], []
            for i in range(0, len(q_ids), 512):
                v = unit(asked.column("raw").slice(i, 512).to_pylist())
                total = sum(t[:, codes[:, j]] for j, t in enumerate(q.tables(v, at)))
                a, b = np.nonzero(total <= bound)
                cosine = [np.einsum("ij,ij->i", v[a[k : k + PAIRS]], x[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)]
                good = (np.concatenate(cosine) >= least) & (q_ids[a + i] != ids[b]) if cosine else np.zeros(0, bool)
                a, b = a[good] + i, b[good]
                np.add.at(n, a, many[b])
                wanted = b << 32 | q_own[a]  # does the entry probe the asking vector's list, and so count this link itself?
                alone = probed[np.minimum(np.searchsorted(probed, wanted), len(probed) - 1)] != wanted
                np.add.at(back, b[alone], q_many[a[alone]])
                left.append(q_ids[a]), right.append(ids[b])
            a, b = np.concatenate(left), np.concatenate(right)
            names, where = np.unique(np.concatenate((a, b)), return_inverse=True)
            a, b, low = where[: len(a)], where[len(a) :], np.arange(len(names))
            while True:  # the smallest id that links of this block reach
                new = low.copy()
                np.minimum.at(new, a, low[b])
                np.minimum.at(new, b, low[a])
                new = new[new]
                if (new == low).all():
                    break
                low = new
            some, more = n > 0, back > 0
            found_id, found_n, found_to = [q_ids[some], ids[more], names], [n[some], back[more], np.zeros(len(names), np.int64)], [q_ids[some], ids[more], names[low]]
        flat = lambda p: pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64())
        return pa.table({"id": flat(found_id), "n": flat(found_n), "to": flat(found_to)})

    keys = ("grp", "list", "block", "q_block")
    return cut(asks.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(compare, "id long, n long, to long"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, margin: float | None = None, most_sample: int = 8192, list_size: int = 128) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    usable, one = classes(vectors)
    found = links(one, least, margin, most_sample, list_size)
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    sums = found.groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("_n"))
    of_class = usable.groupBy("grp", "k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    of_class = of_class.join(sums, F.col("first") == F.col("_id"), "left").join(comps, F.col("first") == comps.id, "left")
    of_class = of_class.select("grp", "k1", "k2", (F.coalesce("_n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    own = usable.join(of_class, ["grp", "k1", "k2"]).select(F.col("vec_id").alias("_v"), "n_links", "component_id")
    out = vectors.select("vec_id").join(own, F.col("vec_id") == F.col("_v"), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
