"""Tables as cells, nested answers, instructions and units: the intake side of schemas."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .predicates import Clause


def spread(cells: list[tuple], rows: int, cols: int) -> dict[tuple[int, int], str]:
    """Texts by row and column from (r, text, row_span, col_span) in reading order. A cell takes the next free column of its row;
    the first cell of a place stays."""
    grid, at = {}, {}
    for r, text, h, w in cells:
        c = at.get(r, 0)
        while (r, c) in grid:
            c += 1
        if c < cols:
            for y in range(r, min(r + h, rows)):
                for x in range(c, min(c + w, cols)):
                    grid.setdefault((y, x), text)
        at[r] = min(c + w, cols)
    return grid


def expand_spans(cells: DataFrame) -> DataFrame:
    """table_idx, r, c, text: merged cells copied over their area. cells: table_idx, r, pos, text, row_span, col_span, n_cols.

    A task walks its tables in order, many in a batch; it holds a table's cells and one batch."""
    columns = ["table_idx", "r", "pos", "text", "row_span", "col_span", "n_cols"]
    schema = "table_idx long, r int, c int, text string"

    def walk(batches):
        out: dict[str, list] = {k: [] for k in ("table_idx", "r", "c", "text")}
        types = {"table_idx": pa.int64(), "r": pa.int32(), "c": pa.int32(), "text": pa.string()}

        def taken():
            done = pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in out], names=list(out))
            for v in out.values():
                v.clear()
            return done

        def close(table, held, cols):
            for (y, x), t in spread(held, held[-1][0] + 1, cols).items():
                out["table_idx"].append(table)
                out["r"].append(y)
                out["c"].append(x)
                out["text"].append(t)

        table, held, cols = None, [], 0
        for batch in batches:
            for idx, r, t, h, w, n in zip(*(batch.column(k).to_pylist() for k in columns if k != "pos"), strict=True):
                if held and idx != table:
                    close(table, held, cols)
                    held, cols = [], 0
                table = idx
                held.append((r, t, h, w))
                cols = max(cols, n)
            yield taken()
        if held:
            close(table, held, cols)
            yield taken()

    return cells.select(*columns).repartition("table_idx").sortWithinPartitions("table_idx", "r", "pos").mapInArrow(walk, schema)


def sheet_layout(cells: DataFrame) -> DataFrame:
    """table_idx, layout, header_row: vertical forms (first column filled, second mostly blank), else the first of 15 rows
    with two short texts. cells: table_idx, r, c, text (r and c from 1)."""
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    rows = cells.groupBy("table_idx", "r").agg(F.count_if(full & (F.length("text") <= 20)).alias("short"), F.count_if(full & (F.col("c") == 1)).alias("a"), F.count_if(full & (F.col("c") == 2)).alias("b"))
    a = rows.groupBy("table_idx").agg(F.sum(F.when(F.col("r") <= 50, F.col("a"))).alias("a"), F.sum(F.when(F.col("r") <= 50, F.col("b"))).alias("b"), F.least(F.max("r"), F.lit(50)).alias("n"), F.min(F.when((F.col("r") <= 15) & (F.col("short") >= 2), F.col("r"))).alias("header_row"))
    vertical = (F.col("a") >= 3) & (1 - F.col("b") / F.col("n") >= 0.5)
    return a.select("table_idx", F.when(vertical, "vertical").when(F.col("header_row").isNotNull(), "table").otherwise("unknown").alias("layout"), F.when(~vertical, F.col("header_row")).alias("header_row"))


def conform(candidates: list[str]) -> Column:
    """The first non-blank of the candidate columns of a target column."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in candidates], F.lit(""))


#: Keys of a unit that aren't fields.
UNIT_KEYS = ("unit_id", "unit_type", "confidence", "evidence", "metadata")


def units(answers: DataFrame, column: str) -> DataFrame:
    """One row for each unit of a unit-aware answer: the other columns, unit_id and unit_type (with defaults), confidence within 0..1
    and 0.8 where unreadable, fields (map) and evidence. Fields are an object, or a list of objects of key and value or of lists of two; without them the
    unit's other keys are its fields. Units that are no objects go, but count in default ids."""
    rest = [c for c in answers.columns if c not in (column, "unit_id", "unit_type", "confidence", "fields", "evidence")]
    each = F.from_json(F.get_json_object(column, "$.units"), "array<variant>")
    u = answers.select(*rest, F.posexplode(each).alias("_i", "_v")).withColumn("_t", F.to_json("_v")).where(F.col("_t").startswith("{"))
    u = u.withColumn("_m", F.from_json("_t", "map<string,string>"))
    get = lambda k: F.try_element_at("_m", F.lit(k))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(get("confidence").try_cast("double"), F.lit(0.8))))
    name = F.coalesce(get("unit_id"), F.concat(F.lit("unit_"), F.lpad((F.col("_i") + 1).cast("string"), 3, "0")))
    two = lambda x: F.from_json(x, "array<string>")
    pair = lambda x: F.when(x.startswith("{"), F.from_json(x, "key string, value string")).when(x.startswith("[") & (F.size(two(x)) == 2), F.struct(two(x)[0].alias("key"), two(x)[1].alias("value")))
    pairs = F.filter(F.transform(F.from_json(get("fields"), "array<variant>"), lambda v: pair(F.to_json(v))), lambda x: x["key"].isNotNull())
    none = F.expr("CAST(map() AS map<string,string>)")
    listed = F.coalesce(F.aggregate(pairs, none, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"]))), none)
    own = F.map_filter("_m", lambda k, _: ~k.isin(*UNIT_KEYS))
    fields = F.when(get("fields").isNull(), own).when(get("fields").startswith("{"), F.from_json(get("fields"), "map<string,string>")).when(get("fields").startswith("["), listed).otherwise(none)
    return u.select(*rest, name.alias("unit_id"), F.coalesce(get("unit_type"), F.lit("unknown")).alias("unit_type"), conf.alias("confidence"), fields.alias("fields"), F.coalesce(get("evidence"), F.lit("")).alias("evidence"))


def unit_summary(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_count, unit_types (in order, blanks left out), mean_confidence: one row for each answer with units."""
    kinds = F.array_sort(F.collect_set(F.nullif("unit_type", F.lit(""))))
    return units.groupBy(*keys).agg(F.count("*").alias("unit_count"), kinds.alias("unit_types"), F.avg("confidence").alias("mean_confidence"))


def flatten_records(rows: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """key, record (map): leaf records of nested JSON. An object with at least 0.3 of the fields is a record; a parent's key
    fills a blank first field. Each level is one projection and is cut before the next, down to the deepest one."""
    level = rows.select("key", F.lit("").alias("parent"), F.col(column).alias("j"))
    found = None
    while True:
        m = level.withColumn("m", F.from_json("j", "map<string,string>")).where("m IS NOT NULL")
        hits = F.size(F.array_intersect(F.map_keys("m"), F.array(*[F.lit(f) for f in fields])))
        flat = hits >= 0.3 * len(fields)
        head = F.when((F.coalesce(F.try_element_at("m", F.lit(fields[0])), F.lit("")) == "") & (F.col("parent") != ""), F.map_concat(F.map_filter("m", lambda k, _: k != fields[0]), F.create_map(F.lit(fields[0]), F.col("parent")))).otherwise(F.col("m"))
        leaf = m.where(flat).select("key", head.alias("record"))
        found = leaf if found is None else found.unionByName(leaf)
        below = m.where(~flat).select("key", F.explode("m").alias("parent", "j"))
        lists = below.where("j LIKE '[%'").select("key", F.lit("").alias("parent"), F.explode(F.from_json("j", "array<string>")).alias("j"))
        level = cut(below.where("j LIKE '{%'").unionByName(lists.where("j LIKE '{%'")))
        if level.isEmpty():
            return found


def instruction_pairs(specs: DataFrame, column: str, headers: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """table_index, filter_field, filter_value, fixed_values: `label: value` lines; the last resolved pair is the filter."""
    known = F.create_map(*[x for k, v in ({h: h for h in headers} | (aliases or {})).items() for x in (F.lit(k), F.lit(v))])
    pairs = F.transform(F.split(column, "\n"), lambda s: F.struct(F.try_element_at(known, F.regexp_extract(F.trim(s), r"^(\S+?)\s*[：:]\s*(.+)$", 1)).alias("k"), F.trim(F.regexp_extract(F.trim(s), r"^(\S+?)\s*[：:]\s*(.+)$", 2)).alias("v")))
    good = F.filter(pairs, lambda p: p["k"].isNotNull())
    d = specs.select("table_index", good.alias("_g")).where(F.size("_g") > 0)
    last = F.element_at("_g", -1)
    newest = F.aggregate("_g", F.expr("CAST(map() AS map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))
    return d.select("table_index", last["k"].alias("filter_field"), last["v"].alias("filter_value"), newest.alias("fixed_values"))


def variants(city: Column) -> Column:
    """A city's name and its other form, with or without 市."""
    return F.array(F.trim(city), F.when(F.trim(city).endswith("市"), F.regexp_replace(F.trim(city), "市$", "")).otherwise(F.concat(F.trim(city), F.lit("市"))))


def city_variants(city: str) -> list[str]:
    """With and without 市."""
    city = city.strip()
    return [] if not city else [city, city[:-1] if city.endswith("市") else city + "市"]


def compile_instruction(text: str) -> list[Clause]:
    """表N blocks with 监测时间 and 城市 as clauses; else a date range as one clause; else none."""
    clauses = []
    for block in re.split(r"(?m)(?=^表\s*\d+\s*[：:])", text or ""):
        time, city = (re.search(rf"{label}\s*[：:]\s*([^\n\r]+)", block) for label in ("监测时间", "城市"))
        if re.match(r"\s*表\s*\d+", block) and time and city:
            t = time[1].strip()
            day = re.match(r"\d{4}[-/]\d\d[-/]\d\d", t)
            clauses.append(Clause({"city": city_variants(city[1]), "monitor_time": [t, *([day[0].replace("/", "-")] if day and day[0].replace("/", "-") != t else [])]}))
    if clauses:
        return clauses
    days = re.findall(r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})", text or "")
    if len(days) < 2:
        return []
    lo, hi = sorted(f"{y}-{int(m):02}-{int(d):02}" for y, m, d in days[:2])
    return [Clause(window=(lo, hi))]


def anchor_backfill(records: DataFrame, field: str, within: list[str], anchor: str = "_anchor_text") -> DataFrame:
    """A task whose records have one value in `field` and three or more usable anchors takes the anchors as values."""
    text = F.trim(F.coalesce(F.col(anchor), F.lit("")))
    usable = (text != "") & (F.length(text) <= 40) & ~text.rlike("[\\n。；;，,]")
    value = F.nullif(F.trim(F.coalesce(F.col(field), F.lit(""))), F.lit(""))
    anchors = records.where(usable).select(*within, text.alias("_t")).distinct().groupBy(*within).agg((F.count("*") >= 3).alias("_some"))
    same = records.groupBy(*within).agg(F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("_same"))
    tasks = anchors.where("_some").join(same.where("_same"), within).select(*within, "_some")
    r = records.join(tasks, within, "left").withColumn(field, F.when(F.col("_some") & usable, text).otherwise(F.col(field)))
    return r.select([c for c in records.columns if c != anchor])


def head_and_tail(paragraphs: DataFrame, head: float = 0.06, tail: float = 0.04) -> DataFrame:
    """Adds part: paragraphs within the first and last shares of a document's characters, up to the first that overflows.
    paragraphs: doc_id, pos, text."""
    n = F.length("text")
    total = F.sum(n).over(Window.partitionBy("doc_id"))
    up = F.sum(n).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum(n).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing))
    part = F.when(up <= F.floor(total * head), "head").when(down <= F.floor(total * tail), "tail")
    return paragraphs.withColumn("part", part).where("part IS NOT NULL")


def sampled(paragraphs: DataFrame, head: float = 0.06, middle: float = 0.05, tail: float = 0.04, whole: int = 5000) -> DataFrame:
    """paragraphs (doc_id, pos, text) of a sample, with part: whole for documents below `whole` characters; else head and tail,
    up to the first paragraph that overflows their share of the characters, and the middle, from the second and third quarter
    of the paragraphs: those with digits and, if these are fewer than three, up to five others. Equal texts come once."""
    n, doc = F.length("text"), Window.partitionBy("doc_id")
    p = paragraphs.withColumns({"_total": F.sum(n).over(doc) + F.count("*").over(doc) - 1, "_n": F.count("*").over(doc)})
    first, last = doc.orderBy("pos"), doc.orderBy(F.desc("pos"))
    p = p.withColumns({"_up": F.sum(n).over(first), "_down": F.sum(n).over(last), "_at": F.row_number().over(first) - 1})
    inside = (F.col("_at") >= F.floor(F.col("_n") / 4)) & (F.col("_at") < F.floor(3 * F.col("_n") / 4))
    p = p.withColumns({"_mid": inside, "_digits": F.col("text").rlike("[0-9]")})
    few = F.count_if(F.col("_mid") & F.col("_digits")).over(doc) < 3
    other = F.count_if(F.col("_mid") & ~F.col("_digits")).over(first)
    p = p.withColumn("_mid", F.col("_mid") & (F.col("_digits") | (few & (other <= 5))))
    p = p.withColumn("_sum", F.sum(F.when(F.col("_mid"), n)).over(doc.orderBy(F.when(F.col("_mid"), 0).otherwise(1), F.when(F.col("_digits"), 0).otherwise(1), "pos")))
    part = F.when(F.col("_total") < whole, "whole").when(F.col("_up") <= F.floor(F.col("_total") * head), "head").when(F.col("_down") <= F.floor(F.col("_total") * tail), "tail")
    part = part.when(F.col("_mid") & (F.col("_sum") <= F.floor(F.col("_total") * middle)), "middle")
    p = p.withColumn("part", part).where("part IS NOT NULL AND trim(text) <> ''")
    again = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.when(F.col("part") == "middle", 2).when(F.col("part") == "tail", 1).otherwise(0), "pos"))
    return p.withColumn("_again", again).where("_again = 1 OR part = 'whole'").select(*paragraphs.columns, "part")
