"""Operator 11: a Merkle manifest of a table, with a proof for each row, by time-forward processing.

A row's leaf is the sha256 of its fields. Each group's leaves, in order, form a tree, and the groups' subroots form the tree of
the whole. A node's label is (last leaf below it, height): children come before their parent. A sweep in order of labels keeps
digests in a priority queue under the label of the parent that waits for them and forms each parent when its children have
arrived; the reversed sweep sends each node's proof suffix, the siblings on its way to the root, from parents to children.

The queue is external: a tree is cut into blocks of arity ** height leaves, messages between blocks are rows that Spark deals
by block and sorts by label (spilling where needed), and only messages inside a block stand in a heap. So a task holds one
block at a time however large a group is; a forward sweep is repeated over the blocks' roots until every tree has one, and the
reversed sweeps follow in the opposite order. Positions in a group come from a range partitioning and counts for each
partition; no window holds a group.

Proofs are strings: a level is `before:after`, the digests of the run's nodes on either side, and levels are joined by
spaces, from the leaf up. `folded` recomputes a root from a leaf and a proof, `siblings` has the digests alone.

Nulls and edge cases: a null field is `-`, unlike an empty text (`0:`); a null group is a group of its own and the first one;
null ids stand before others and equal ids by their leaves, so that the order of input rows never matters; identical rows
have identical leaves and proofs of their own; a tree of one leaf is that leaf; columns other than the named fields don't
count; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC32, crc32_of, cut, removed, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block: 2 ** HEIGHT.
HEIGHT = 10


def digest(fields: list[Column | str]) -> Column:
    """sha256 of fields one after another, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    values = [(F.col(f"`{f}`") if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def siblings(proof: Column | str) -> Column:
    """A proof's digests one after another."""
    return F.translate(proof, " :", "")


def folded(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf has with this proof."""
    leaf, proof = (F.col(c) if isinstance(c, str) else c for c in (leaf, proof))

    def up(h, level):
        return F.sha2(F.concat(F.substring_index(level, ":", 1), h, F.substring_index(level, ":", -1)).cast("binary"), 256)

    return F.when(proof == "", leaf).otherwise(F.aggregate(F.split(proof, " "), leaf, up))


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _sweep(leaves: list[str], levels: int, arity: int) -> tuple[str, list[tuple]]:
    """The root and the tape: (height, position, children's digests) of all inner nodes in order of their labels."""
    n, queue, tape, root = len(leaves), [], [], leaves[0]

    def deliver(height: int, at: int, value: str) -> None:
        """To the parent, at its time: the last leaf below it."""
        last = min((at // arity + 1) * arity ** (height + 1), n) - 1
        heapq.heappush(queue, (last, height + 1, at // arity, at, value))

    for i, leaf in enumerate(leaves):
        if levels:
            deliver(0, i, leaf)
        while queue and queue[0][0] == i:
            _, height, at, _, value = heapq.heappop(queue)
            children = [value]
            while queue and queue[0][:3] == (i, height, at):
                children.append(heapq.heappop(queue)[4])
            tape.append((height, at, children))
            root = _hash(children)
            if height < levels:
                deliver(height, at, root)
    return root, tape


def _proofs(leaves: list[str], levels: int, arity: int, suffix: str) -> list[str]:
    """Each leaf's way to the root above the block: the tape in reversed order, with a queue from the last label to the first."""
    n = len(leaves)
    if not levels:
        return [suffix]
    out, queue = [""] * n, []

    def deliver(height: int, at: int, path: str) -> None:
        if height:
            heapq.heappush(queue, (1 - min((at + 1) * arity**height, n), -height, at, path))
        else:
            out[at] = path

    deliver(levels, 0, suffix)
    for height, at, children in reversed(_sweep(leaves, levels, arity)[1]):
        _, h, to, path = heapq.heappop(queue)
        if (-h, to) != (height, at):
            raise RuntimeError("labels out of order")
        path = f" {path}" if path else ""
        for k in range(len(children)):
            deliver(height - 1, at * arity + k, f"{''.join(children[:k])}:{''.join(children[k + 1 :])}{path}")
    return out


def _blocks(batches):
    """The rows of each block, as tables, from rows sorted by tree, block and position."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _levels(size: int, arity: int, height: int) -> int:
    """Of a block: all if its tree has several blocks, else until one node remains."""
    if size > arity**height:
        return height
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def _up(arity: int, height: int):
    def up(batches):
        schema = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
        out = []
        for t in _blocks(batches):
            size = t["size"][0].as_py()
            root = _sweep(t["digest"].to_pylist(), _levels(size, arity, height), arity)[0]
            out.append((t["tree"][0].as_py(), t["block"][0].as_py(), -(-size // arity**height), root))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return up


def _down(arity: int, height: int):
    def down(batches):
        for t in _blocks(batches):
            leaves = t.slice(1)  # the message stands first
            paths = _proofs(leaves["digest"].to_pylist(), _levels(leaves["size"][0].as_py(), arity, height), arity, t["path"][0].as_py())
            subroot = pa.array([t["subroot"][0].as_py()] * len(paths), pa.string())
            for name, values in (("path", pa.array(paths, pa.string())), ("subroot", subroot)):
                leaves = leaves.set_column(leaves.schema.get_field_index(name), name, values)
            yield from leaves.combine_chunks().to_batches()

    return down


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("i").asc_nulls_first())


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """df with i, the position in the row's tree ordered by `by`, and size, the tree's number of rows. df is read twice."""
    df, _ = written(df.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by).withColumn("at", F.monotonically_increasing_id()), "ranked")
    df = df.withColumn("part", F.shiftright("at", 33))
    counts = df.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each range, and for each tree
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")))
    return df.join(counts, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _rounds(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Nodes (tree, i, size, digest) and, after each forward sweep, the blocks' roots, until each tree has one."""
    rounds = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 0
    while size > 1:
        last = rounds[-1].select("tree", "i", "size", "digest", _block(arity, height))
        rounds.append(cut(_in_blocks(last).mapInArrow(_up(arity, height), "tree string, i long, size long, digest string")))
        size = -(-size // arity**height)
    return rounds


def _block(arity: int, height: int) -> Column:
    return F.expr(f"i div {arity**height}").alias("block")


def _suffixes(rounds: list[DataFrame], top: DataFrame, arity: int, height: int) -> DataFrame:
    """The first round's nodes with path, the way to the root, and subroot; top: (tree, path, subroot), a row for each tree."""
    above, none = top.withColumn("i", F.lit(0).cast("long")), F.lit(None).cast("string")
    for nodes in reversed(rounds[:-1]):
        nodes = nodes.select("*", _block(arity, height), none.alias("path"), none.alias("subroot"))
        rows = nodes.unionByName(above.select("tree", F.col("i").alias("block"), "path", "subroot"), allowMissingColumns=True)
        above = _in_blocks(rows).mapInArrow(_down(arity, height), rows.schema).drop("block")
    return above if len(rounds) > 1 else rounds[0].join(top, "tree")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", arity: int = 2, height: int = HEIGHT, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row: `order`, `group`, the columns of `carry` (expressions on docs), leaf, subroot, root and proof."""
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null before all, then by bytes
    rows = docs.select(tree.alias("tree"), F.col(f"`{order}`").alias("_order"), F.col(f"`{group}`").alias("_group"), digest(list(fields)).alias("digest"), *[c.alias(f"_carry_{k}") for k, c in carry.items()])
    rows, path = written(rows, "leaves")  # digests only: texts are read once
    nodes = _ranked(rows, ["_order", "digest"])
    removed(docs.sparkSession, path)
    rounds = _rounds(nodes, arity, height)
    groups, _ = written(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    top = _rounds(_ranked(groups, ["name"]), arity, height)
    root = top[-1].select("digest").first()  # one digest
    start = top[-1].select("tree", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    ways = cut(_suffixes(top, start, arity, height).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")))
    out = _suffixes(rounds, ways, arity, height).withColumn("root", F.lit(root and root[0]).cast("string"))
    carried = [F.col(f"_carry_{k}").alias(k) for k in carry]
    return out.select(F.col("_order").alias(order), F.col("_group").alias(group), *carried, F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"))


def _sql_digest(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"])
    found = manifest(docs, carry={"_found": F.when(tampered, changed)})
    folded_root = folded(F.coalesce("_found", "leaf"), "proof")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof").cast("binary"), 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = f"""
WITH RECURSIVE {CRC32}
docs AS (SELECT doc_id, lang, n_chars, {_sql_digest("n_chars")} AS leaf, {_sql_digest("n_chars + 1")} AS changed, {crc32_of("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL AS tampered FROM documents, remainders),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs),
up AS (SELECT lang, 0 AS level, i, n, leaf AS digest FROM placed
       UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, digest, level AS levels, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, n, digest FROM subroots
        UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (SELECT p.doc_id, u.level, (p.i >> u.level) & 1 = 1 AS on_right, s.digest AS sibling
          FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.i = p.i >> u.level AND u.n > 1 LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.i = xor(u.i, 1)
          UNION ALL
          SELECT p.doc_id, r.levels + u.level, (r.i >> u.level) & 1 = 1, s.digest
          FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN top u ON u.i = r.i >> u.level AND u.n > 1 LEFT JOIN top s ON s.level = u.level AND s.i = xor(u.i, 1)),
fold AS (SELECT doc_id, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM placed
         UNION ALL SELECT f.doc_id, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.on_right THEN s.sibling || f.h ELSE f.h || s.sibling END) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.n = 1 LEFT JOIN proofs USING (doc_id) JOIN ends e USING (doc_id)
"""
