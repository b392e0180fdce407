"""The operators against plain Python on the small table and on odd rows."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import line_dedup, media, mixing, ngram_join, packing, repair, tokens, toxicity

from .helpers import LINE, WORD, ascii_lower, odd_documents, table_of, words


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def docs(request, spark):
    if request.param == "small":
        return table_of(spark)
    odd = odd_documents(spark)
    return odd.limit(0) if request.param == "empty" else odd


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n b", "  x 　y", "it's  'll x", "<|endoftext|> a<|endoftext|>", "1 2\t3\r\n 4", "é́ ß", "a \x1c b", "a \x85b ​c"])
def test_tokens_by_pieces(text):
    assert np.frombuffer(tokens.encode([text], tokens.default_path())[0], "<u4").tolist() == ids_of(text)


def components(links, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_line_dedup(docs):
    rows = texts(docs)
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows.items():
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got.keys() == rows.keys()
    for d, t in rows.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != d)]
        assert (got[d].text or "", got[d].n_lines, got[d].n_dropped) == ("\n".join(keep), len(lines), len(lines) - len(keep))


def test_line_dedup_of_null_and_clashing_ids(spark):
    shared = LINE
    rows = [(None, f"{shared}\nalpha"), (None, f"beta\n{shared}"), (7, f"{shared}\nown"), (7, f"first\n{shared}\n{shared}"), (7, f"first\n{shared}\n{shared}"), (8, shared), (9, f"x\n {shared.upper()}"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS dropped", "2 AS n_lines", "3 AS n_dropped", "4 AS copy", "5 AS gone")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs).collect()), key=repr)
    want = [(None, "alpha", 2, 1), (None, "beta", 2, 1), (7, "own", 2, 1), (7, "first", 3, 2), (7, "first", 3, 2), (8, "", 1, 1), (9, f"x\n {shared.upper()}", 2, 0), (9, None, 1, 0)]
    assert got == sorted(want, key=repr)


def test_line_dedup_sql(spark, duck):
    from tests.conftest import SF

    got = line_dedup.query(spark, SF).collect()
    want = duck.execute(line_dedup.SQL).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing(docs):
    rows = texts(docs)
    got = packing.best_fit_packing(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == rows.keys()
    for d, t in rows.items():
        ids = ids_of(t) + [2]
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for slots in by_seq.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by_seq) <= math.ceil(total / 1024) * 1.03 + 2


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 400))
        counts = Counter(lengths.tolist())
        rows = sorted(packing.plan(counts, 64))
        used, n = {}, 0
        for k, (length, rank, first, offset) in enumerate(rows):
            end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else counts[length]
            for s in range(first, first + end - rank):
                used.setdefault(s, []).append((offset, length))
                n += 1
        assert n == len(lengths)
        for slots in used.values():
            ends = 0
            for o, size in sorted(slots):
                assert o == ends
                ends += size
            assert ends <= 64
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - x)
            else:
                rooms.append(64 - x)
        assert len(used) <= len(rooms) * 1.02 + 1


def test_mixing(docs):
    rows = {r.doc_id: (r.source, len(words(r.text))) for r in docs.collect()}
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes = Counter()
    for s, n in rows.values():
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if 3 * sizes[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for d, (s, n) in rows.items():
        r = got[d]
        assert (r.size, r.source_size) == (n, sizes[s]) and 0 <= r.taken <= 3 * n
        assert r.target == pytest.approx(3 * sizes[s] if s in capped else level * weight[s])
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - (3 * sizes[s] if s in capped else level * weight[s])) <= 1


def test_mixing_replaces_columns_of_its_names(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    docs = odd_documents(spark)
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "target", "taken").collect()))
    more = docs.selectExpr("*", "'x' AS size", "1 AS source_size", "2 AS target", "3 AS whole", "4 AS taken")
    assert sorted(map(tuple, mixing.mix(more).select("doc_id", "size", "target", "taken").collect())) == want


def test_mixing_again(spark):
    docs = table_of(spark)
    one = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()))


def test_media(docs):
    rows = texts(docs)
    stored = media.media_tiles(media.text_images(docs))
    tiles = {r.doc_id: r.tiles for r in stored.collect()}
    for r in media.features(stored).collect():
        data = (rows[r.doc_id] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        whole = b"".join(bytes(t) for t in tiles[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest())
        assert len(r.feature) == 16


def test_media_formats():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(b"P5 # note\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P6\n7 5 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    row = lambda a: a.tobytes() + b"\0" * (-a.nbytes % 4)
    body = b"".join(row(r[:, ::-1]) for r in colour[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(body), 0, 0, 0, 0)
    assert (media.decode(head + body) == colour).all()
    small = media.area_resize(grey, 2, 3)
    whole = np.kron(grey, np.ones((6, 6)))  # 30 x 42: boxes of whole pixels
    assert small == pytest.approx(whole.reshape(2, 15, 3, 14).mean((1, 3)))
    assert (media.read_tiles(media.tiles(colour, 2)) == colour).all()
    assert media.decode(b"P2 3 1 15\n0 7 15").tolist() == [[0, 119, 255]] and media.decode(b"P5 2 1 1\n\0\1").tolist() == [[0, 255]]
    body = b"".join(struct.pack("<I", r << 4 | g << 12 | b << 20) for r, g, b in ((255, 0, 1), (2, 255, 3)))
    head = b"BM" + struct.pack("<IHHI", 66 + len(body), 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 32, 3, len(body), 0, 0, 0, 0) + struct.pack("<3I", 255 << 4, 255 << 12, 255 << 20)
    assert media.decode(head + body).tolist() == [[[255, 0, 1], [2, 255, 3]]]
    for bad in (b"GIF89a", b"P2 1 1 255\n300", b"P5 9 9 255\nx", b"BM", b"P5 1 1 0\n0", b"P2 99999 99999 1\n1"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(bad)


def test_media_of_images_without_pixels_and_broken_ones(spark):
    rows = [(1, 9, b"P5 0 0 255\n"), (2, 9, b"P2 1 1 255\n300"), (3, 0, None), (4, 1, b"P5 1 1 255\n7")]
    got = {r.doc_id: r for r in media.features(media.media_tiles(spark.createDataFrame(rows, "doc_id long, n_bytes long, image binary"))).collect()}
    assert (got[1].payload_bytes, got[1].feature) == (0, "") and got[2].payload_bytes is None and got[3].feature is None
    assert (got[4].payload_bytes, got[4].payload_sha256) == (1, hashlib.sha256(b"7").hexdigest())


def test_repair(docs):
    rows = texts(docs)
    shards, _ = repair.write_shards(docs, shard_tokens=20_000)
    start = 0
    got = sorted(repair.read_shards(shards).collect())
    assert [r.doc_id for r in got] == sorted(rows)
    for r in got:
        ids = ids_of(rows[r.doc_id]) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    for row in shards.collect():
        for i, d in list(enumerate(np.frombuffer(row["docs"], "<i8").tolist()))[::7]:
            ids = ids_of(rows[d]) + [0]
            assert repair.read_document(row, i).tolist() == ids
            for a, n in ((0, 1), (len(ids) // 3, 5), (len(ids) // 2, len(ids)), (len(ids) - 1, 1), (len(ids), 3)):
                assert repair.read_range(row, i, a, n).tolist() == ids[a : a + n]


def test_repair_compresses():
    ids = np.tile(np.array([5, 6, 7, 8, 5, 6], np.uint16), 500)
    rules, size, symbols, ends = repair.compress(ids, np.array([1500, 3000]))
    assert len(symbols) < 400 and size.max() >= 8
    assert (repair.expand(rules, size, symbols) == ids).all()
    assert (repair.expand(rules, size, symbols[: ends[0]]) == ids[:1500]).all()
    with pytest.raises(ValueError):
        repair.compress(np.array([5, 60_000]), np.array([2]))


def shingles(text):
    w = [ascii_lower(x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(sets):
    found = []
    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    seen = {(a, b) for ds in index.values() for a in ds for b in ds if a < b}
    for a, b in seen:
        i = len(sets[a] & sets[b])
        if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            found.append((a, b))
    return found


def check_join(docs):
    sets = {d: shingles(t) for d, t in texts(docs).items()}
    links = linked(sets)
    want = components(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    return len(links)


def test_ngram_join(docs):
    check_join(docs)


def test_ngram_join_of_near_copies(spark, monkeypatch):
    """Families of copies with changed words, at all sizes and near the limit, and a passage that all documents share."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"p{i}" for i in range(40))
    out = []
    for n in [3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 90, 160, 300, 700]:
        for _ in range(3):
            base = [f"v{x}" for x in rng.integers(0, 10**6, n)]
            for _ in range(6):
                w = list(base)
                for _ in range(rng.integers(0, max(2, n // 30 + 2))):
                    i = rng.integers(0, len(w))
                    w[i : i + rng.integers(0, 2)] = [f"n{rng.integers(0, 10**6)}"]
                out.append(" ".join(w) + (" " + shared if rng.random() < 0.5 else ""))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(out)], "doc_id long, text string")
    assert check_join(docs) > 100
    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # keys are cut into blocks
    monkeypatch.setattr(ngram_join, "GROUP_KEYS", 100)  # many keys are too frequent to be counted
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    check_join(docs)


def test_kept_keys_meet_within_the_bound():
    """Two sets within H differences share a key that both keep, whatever the keys cost."""
    rng = np.random.default_rng(8)
    schemes = ngram_join.plan_schemes(2000)
    deletions = np.array([s.deletions for s in schemes])
    assert deletions.any() and not deletions.all()
    for _ in range(1500):
        a = int(rng.choice([3, 4, 6, 7, 9, 14, 15, 27, 48, 60, 87, 90, 157, 400]))
        both = rng.integers(0, 2**63, 2 * a).astype(np.uint64) * np.uint64(2)
        b = int(rng.integers(a, 4 * a // 3 + 1))
        h = (a + b) // 7
        common = (a + b - h + 1) // 2
        if common > a:
            continue
        x, y = np.sort(both[:a]), np.sort(np.concatenate((both[:common], rng.integers(0, 2**63, b - common).astype(np.uint64))))
        s = next(s for s in schemes if b <= s.high)
        assert s in ngram_join.schemes_of(a, schemes) and s in ngram_join.schemes_of(b, schemes)
        keys = s.keys(x), s.keys(y)
        shared = np.intersect1d(*keys)
        costs = {k: rng.integers(1, 6) + 5 * (rng.random() < 0.5) for k in shared.tolist()}  # what they share costs most
        kept = []
        for which, size in zip(keys, (a, b), strict=True):
            k = np.array([v for v in np.unique(which).tolist() if v in costs or rng.random() < 0.3], np.uint64)
            cost = np.array([costs.get(v, 1) for v in k.tolist()], np.uint8)
            n = len(k)
            stay = ngram_join.kept_keys(np.zeros(n, np.int64), np.full(n, s.number, np.uint8), np.full(n, s.spare(size), np.uint32), k, cost, deletions)
            kept.append(k[stay])
        assert len(np.intersect1d(*kept))


def test_toxicity(spark):
    docs, labels = (table_of(spark, t, "/root/testdata/sf0.1") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where(toxicity.fold_of(labels.doc_id) == 0).select("score", "toxic").toPandas()
    hit = (got.score >= 0.5) == (got.toxic == 1)
    assert hit.mean() > 0.95
    assert ((got.score >= 0.5) & (got.toxic == 0)).sum() <= 0.01 * len(got)
    assert ((got.score >= 0.5) & (got.toxic == 1)).sum() >= 0.75 * (got.toxic == 1).sum()


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2) for i in range(14)], "doc_id long, toxic int")
    assert docs.count() == toxicity.toxicity(docs, labels).where("score between 0 and 1").count()
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_word_pattern():
    assert WORD.findall("a\x0bb\x1fc d") == ["a", "b\x1fc d"]


def test_ngram_join_without_shared_keys(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    assert check_join(docs) == 0


def test_forest_spans_and_is_least():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 120))
        x, y, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 6, m)
        got, root, total, taken = ngram_join.forest(x, y, w), list(range(n)), 0, 0

        def top(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for k in np.argsort(w, kind="stable").tolist():  # Kruskal's way
            a, b = top(int(x[k])), top(int(y[k]))
            if a != b:
                root[a], total, taken = b, total + int(w[k]), taken + 1
        assert (len(got), int(w[got].sum())) == (taken, total)


def test_standing_keys_keep_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = {(int(k), int(d)) for d in range(60) for k in rng.integers(0, 25, 6)} | {(100 + k, d) for k in range(10) for d in range(30 - k)}
    df = spark.createDataFrame(sorted(rows), "key long, doc long")
    held = df.groupBy("key").agg(F.count("*").alias("held"))
    left = {(r.key, r.doc) for r in ngram_join.standing(df.join(held, "key")).collect()}
    assert {k for k, _ in left if k >= 100} == {100}  # the others' holders all hold key 100

    def pairs(rows):
        by = {}
        for k, d in rows:
            by.setdefault(k, []).append(d)
        return {(a, b) for ds in by.values() for a in ds for b in ds if a < b}

    assert pairs(left) == pairs(rows)


def test_hot_keys_are_dealt_by_document(spark):
    """A key too frequent to be counted meets no task whole: its groups grow with the documents of a group only."""
    shared = " ".join(f"p{i}" for i in range(150))
    docs = spark.createDataFrame([(i, f"{shared} " + " ".join(f"o{i}x{j}" for j in range(10))) for i in range(2000)], "doc_id long, text string")
    schemes = ngram_join.plan_schemes(400)
    sets = ngram_join.shingle_sets(pa.array([r.text for r in docs.limit(50).collect()]))
    keys, n = np.unique(np.concatenate([s.keys(h) for h in sets for s in ngram_join.schemes_of(len(h), schemes)]), return_counts=True)
    hot = keys[n >= 25]  # in half of all documents or more
    assert len(hot) > 5
    packed = ngram_join.keys_of(docs, schemes, 64, hot)
    most = packed.where("grp < 0").groupBy("grp", "high").agg(F.sum(F.length("docs") / 8).alias("n"))
    assert most.agg(F.max("n")).first()[0] < 100
    posts = ngram_join.costed(packed, 64)
    back = posts.where(F.expr("exists(transform(sequence(1, length(costs)), i -> substring(costs, i, 1)), c -> c = X'FF')"))
    assert back.agg(F.sum(F.length("keys") / 4)).first()[0] >= 800 * len(hot)
