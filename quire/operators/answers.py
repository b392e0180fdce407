"""Model answers to records: repair of almost-JSON text as a pushdown scan in one higher-order aggregate, and rejects.

An answer is cut into tokens (strings with their escapes, brackets, colons, commas, bare words). One aggregate over the tokens
keeps the stack of open brackets and notes where each outermost value starts and ends, which closers are missing and which
are strays; text outside of these values is prose or a fence and goes. Every other repair looks at a token and its
neighbours only. No value's text grows inside the aggregate, so an answer's cost grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A string, one that the end cuts off, a string in single quotes, a bracket or separator, or a bare run up to one or a line's end.
TOKEN = r""""(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\\?\z|'(?:[^'\\\n]|\\.)*'(?=\s*[:,}\]])|[{}\[\]:,]|[^\s{}\[\]:,"][^{}\[\]:,"\n]*"""
_LITERAL = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
_WORDS = {"True": "true", "False": "false", "None": "null", "undefined": "null"}
_STATE = "struct<i: int, stack: string, start: int, roots: array<struct<s: int, e: int, close: string>>, fixes: array<struct<i: int, before: string, drop: boolean>>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _closers(stack: Column) -> Column:
    return F.translate(stack, "{[", "}]")


def _scanned(tokens: Column) -> Column:
    """The outermost values (first and last token, closers that are missing at the end) and the closers to mend. The stack is a
    text, the innermost bracket first."""
    none_roots, none_fixes = F.expr("CAST(array() AS array<struct<s: int, e: int, close: string>>)"), F.expr("CAST(array() AS array<struct<i: int, before: string, drop: boolean>>)")

    def state(i, stack, start, roots, fixes):
        return F.struct(i.cast("int").alias("i"), stack.alias("stack"), start.cast("int").alias("start"), roots.alias("roots"), fixes.alias("fixes"))

    def step(a, t):
        i, stack = a["i"], a["stack"]
        opened = state(i + 1, F.concat(t, stack), F.when(stack == "", i).otherwise(a["start"]), a["roots"], a["fixes"])
        depth = F.instr(stack, F.when(t == "}", "{").otherwise("["))  # of the bracket that it closes; 0: none
        rest = F.substring(stack, depth + 1, F.length(stack))
        fix = F.struct(i.alias("i"), _closers(F.substring(stack, F.lit(1), depth - 1)).alias("before"), (depth == 0).alias("drop"))
        fixes = F.when(depth == 1, a["fixes"]).otherwise(F.concat(a["fixes"], F.array(fix)))
        root = F.struct(a["start"].alias("s"), i.alias("e"), F.lit("").alias("close"))
        roots = F.when((depth > 0) & (rest == ""), F.concat(a["roots"], F.array(root))).otherwise(a["roots"])
        closed = state(i + 1, F.when(depth > 0, rest).otherwise(stack), a["start"], roots, fixes)
        other = state(i + 1, stack, a["start"], a["roots"], a["fixes"])
        return F.when(t.isin("{", "["), opened).when(t.isin("}", "]") & (stack != ""), closed).otherwise(other).cast(_STATE)

    def finish(a):
        last = F.struct(a["start"].alias("s"), (a["i"] - 1).alias("e"), _closers(a["stack"]).alias("close"))
        return F.struct(F.when(a["stack"] == "", a["roots"]).otherwise(F.concat(a["roots"], F.array(last))).alias("roots"), a["fixes"].alias("fixes"))

    return F.aggregate(tokens, state(F.lit(0), F.lit(""), F.lit(0), none_roots, none_fixes).cast(_STATE), step, finish)


def _quoted(body: Column) -> Column:
    """A bare word or the inside of single quotes as a string."""
    return F.concat(F.lit('"'), F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _string(t: Column) -> Column:
    """A string with its control characters escaped and, where the end cut it off, closed; a cut escape goes."""
    out = t
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    whole = t.rlike(r'(?s)^"(?:[^"\\]|\\.)*"$')
    return F.when(whole, out).otherwise(F.concat(F.regexp_replace(out, r"((?:^|[^\\])(?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?$", "$1"), F.lit('"')))


def _bare(t: Column, following: Column) -> Column:
    word = F.rtrim(t)
    literal = word
    for had, want in _WORDS.items():
        literal = F.when(word == had, F.lit(want)).otherwise(literal)
    single = word.rlike(r"^'.*'$")
    body = F.when(single, F.replace(F.substring(word, F.lit(2), F.length(word) - 2), F.lit("\\'"), F.lit("'"))).otherwise(word)
    return F.when(F.coalesce(following == ":", F.lit(False)) | single | ~literal.rlike(_LITERAL), _quoted(body)).otherwise(literal)


def _values(tokens: Column) -> Column:
    """Texts of the outermost values, mended."""

    def value(found, root):
        # a key that the end cut off goes, with the comma before it
        before = F.get(tokens, root["e"] - 1)
        cut = root["close"].startswith("}") & before.isin("{", ",") & ~F.get(tokens, root["e"]).isin("{", "}", "[", "]", ":", ",")
        return let(F.when(cut, root["e"] - 1).otherwise(root["e"]), lambda end: F.concat(F.array_join(F.transform(F.sequence(root["s"], end), lambda i: piece(found, root, end, i)), ""), root["close"]))

    def piece(found, root, end, i):
        t, p = F.get(tokens, i), F.when(i > root["s"], F.get(tokens, i - 1))
        n = F.when(i < end, F.get(tokens, i + 1))
        gone = n.isNull() | n.isin("}", "]", ",") | p.isin("{", "[")
        mended = (
            F.when(t == ",", F.when(gone, "").otherwise(","))
            .when(t == ":", F.when(n.isNull() | n.isin("}", "]", ","), ":null").otherwise(":"))
            .when(t.isin("{", "["), t)
            .when(t.isin("}", "]"), let(F.get(F.filter(found["fixes"], lambda f: f["i"] == i), F.lit(0)), lambda f: F.when(f.isNull(), t).when(f["drop"], "").otherwise(F.concat(f["before"], t))))
            .when(t.startswith('"'), _string(t))
            .otherwise(_bare(t, n))
        )
        return mended

    return let(_scanned(tokens), lambda found: F.transform(found["roots"], lambda root: value(found, root)))


def _pieces(text: Column) -> Column:
    """JSON lines are texts of their own; any other answer is one."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    return let(lines, lambda x: F.when((F.size(x) > 1) & F.forall(x, lambda y: y.rlike(r"^(\{.*\}|\[.*\])$")), x).otherwise(F.array(text)))


def json_values(text: Column | str) -> Column:
    """array<string>: the JSON objects and lists of an answer, each mended until it parses; those that nothing mends are null.
    A null answer is null, one without brackets has none."""
    text = F.col(text) if isinstance(text, str) else text
    values = F.flatten(F.transform(_pieces(text), lambda t: let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), _values)))
    return F.when(text.isNotNull(), F.transform(values, lambda v: F.when(F.try_parse_json(v).isNotNull(), v)))


def records(responses: DataFrame, column: str, schema: str, under: str = "records") -> tuple[DataFrame, DataFrame]:
    """(records, rejects). Records: the other columns, pos (from 0 in an answer) and record, a struct of `schema`, for each object
    of an answer: the objects of a list, those of an object's list `under`, or the object itself. Rejects: answers with reason:
    `no answer` (null), `no JSON` (no brackets), `broken` (a value that nothing mends), `no record` (lists without objects); an
    answer's sound values stay records although it is rejected for a broken one. No row is lost: each answer has a record or a
    reject. Columns of the results' names are replaced."""
    rest = [c for c in responses.columns if c not in (column, "pos", "record", "reason")]
    r = responses.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("_text")).withColumn("_values", json_values("_text"))

    def objects(v):
        inner = F.get_json_object(v, f"$.{under}")
        listed = F.when(v.startswith("["), v).when(inner.startswith("["), inner)
        each = F.transform(F.from_json(listed, "array<variant>"), lambda x: F.to_json(x))
        return F.when(listed.isNull(), F.array(v)).otherwise(F.filter(each, lambda x: x.startswith("{")))

    r = r.withColumn("_objects", F.flatten(F.transform(F.filter("_values", lambda v: v.isNotNull()), objects)))
    good = r.select(*[F.col(f"`{c}`") for c in rest], F.posexplode("_objects").alias("pos", "_o")).withColumn("record", F.from_json("_o", schema)).drop("_o")
    reason = F.when(F.col("_text").isNull(), "no answer").when(F.size("_values") == 0, "no JSON").when(F.exists("_values", lambda v: v.isNull()), "broken").when(F.size("_objects") == 0, "no record")
    bad = r.withColumn("reason", reason).where("reason IS NOT NULL").select(*[F.col(f"`{c}`") for c in rest], F.col("_text").alias(column), "reason")
    return good, bad
