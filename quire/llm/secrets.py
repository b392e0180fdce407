"""Operator 7: secrets by patterns and by a battery of randomness tests, in DataFrame functions alone.

Base spans come from three patterns. The method adds spans: runs of 20 or more characters of the usual encodings are
candidates; the narrowest alphabet that fits is inferred, and three tests are made on the symbols' ranks: chi-squared
uniformity over the alphabet, runs above and below the middle, and correlation of neighbours. A candidate is random enough if
the three together do not reject uniform symbols. It is a discovery if it is also far from ordinary text of its length in that
alphabet: by its chi-squared, which ordinary text exceeds, and, in alphabets of several classes (digits, upper and lower
case), by its runs of a class, of which ordinary text has few. Both give one p-value, which falls with length, so a short run
needs to be more even than a long one, and the Benjamini-Hochberg rule over the candidates of all documents controls the share
of false ones. The rule needs counts of p-values in fixed bins only (at most BINS rows reach the driver). Tokens of 32
characters are found in all alphabets but letters of one case, which are too like words below some 80 characters.

Nulls and edge cases: a null or empty text has no spans; the hash of no spans is that of the empty string; candidates that
overlap a base span are left to it; repeated rows give equal rows, and count as often in the false-discovery rule; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# The three base patterns, their least lengths, and the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets from narrow to wide, and by how much ordinary text exceeds even use: size x sum of squared shares - 1.
ALPHABETS = (
    (DIGITS, 2.5), (DIGITS + "abcdef", 1.5), (DIGITS + "ABCDEF", 1.5), (LOWER, 0.75), (UPPER, 0.75), (UPPER + "234567", 1.3), (DIGITS + LOWER, 1.2),
    (UPPER + LOWER, 2.3), (UPPER + LOWER + DIGITS, 2.7), (UPPER + LOWER + DIGITS + "+/", 2.8), (UPPER + LOWER + DIGITS + "-_", 2.8),
)
#: Changes of class (digit, upper case, lower case) that ordinary text has for each character.
CHANGES = 0.08
BINS, PER_DECADE = 600, 20


def spans(text, pattern: str, kind: int, keep, found: str | None = None):
    """Array of (start, kind, end) of the matches that keep(match, group 2) admits, in code points."""
    two = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if "(" in pattern else 0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), two.alias("g"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,run:string>>)")

    def step(state, x):
        at = state["at"] + F.length(x["0"])
        end = at + F.coalesce(F.length(x["1"]), F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["1"].alias("run")))
        return F.struct(end.alias("at"), F.when(x["1"].isNotNull() & keep(x["1"], x["2"]), F.concat(state["all"], one)).otherwise(state["all"]).alias("all"))

    named = F.transform(parts, lambda x: F.struct(x["p"].alias("0"), x["m"].alias("1"), x["g"].alias("2")))
    walked = F.aggregate(named, F.struct(F.lit(0).alias("at"), none.alias("all")), step)
    return F.when(F.regexp_like(text, F.lit(found or pattern)), walked["all"]).otherwise(none)


def statistics(run):
    """(n, size, chi, excess, changes, battery) of a candidate: length, alphabet, chi-squared, ordinary excess, changes of class
    (null in an alphabet of one class), and the battery's sum."""
    body = F.rtrim(run, F.lit("="))
    choice = F.coalesce(*[F.when(F.length(F.translate(body, a, "")) == 0, F.struct(F.lit(a).alias("a"), F.lit(x).alias("x"))) for a, x in ALPHABETS], F.struct(F.lit(UPPER + LOWER + DIGITS + "+/").alias("a"), F.lit(2.8).alias("x")))

    def of(state):
        body, alphabet, excess = state["body"], state["c"]["a"], state["c"]["x"]
        n, size = F.length(body).cast("double"), F.length(alphabet).cast("double")
        ranks = F.transform(F.split(body, ""), lambda ch: F.instr(alphabet, ch).cast("double") - 1)
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")
        changes = F.when(~alphabet.isin(DIGITS, LOWER, UPPER), F.length(classes).cast("double") - 1)
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, ch: s + F.pow(n - F.length(F.replace(body, ch)), F.lit(2)))
        return F.struct(n.alias("n"), size.alias("size"), (squares * size / n - n).alias("chi"), excess.alias("excess"), ranks.alias("v"), changes.alias("changes"))

    def battery(s):
        n, size, v, df = s["n"], s["size"], s["v"], s["size"] - 1
        cube = (F.pow(F.greatest(s["chi"], F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.transform(v, lambda x: (x >= size / 2).cast("double"))
        ones = F.aggregate(high, F.lit(0.0), lambda a, x: a + x)
        zeros = n - ones
        pairs = F.zip_with(F.slice(high, 1, F.size(v) - 1), F.slice(high, 2, F.size(v) - 1), lambda x, y: (x != y).cast("double"))
        runs = F.aggregate(pairs, F.lit(1.0), lambda a, x: a + x)
        expected = 2 * ones * zeros / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        about = F.transform(v, lambda x: x - mean)
        var = F.aggregate(about, F.lit(0.0), lambda a, x: a + x * x)
        lag = F.aggregate(F.zip_with(F.slice(about, 1, F.size(v) - 1), F.slice(about, 2, F.size(v) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        serial = F.when(var > 0, lag / var * F.sqrt(n)).otherwise(F.lit(99.0))
        total = F.pow(F.greatest(cube, F.lit(0.0)), F.lit(2)) + F.pow((runs - expected) / spread, F.lit(2)) + serial * serial
        return F.struct(s["n"].alias("n"), size.alias("size"), s["chi"].alias("chi"), s["excess"].alias("excess"), s["changes"].alias("changes"), total.alias("battery"))

    held = F.transform(F.array(F.struct(body.alias("body"), choice.alias("c"))), of)
    return F.transform(held, battery)[0]


def lower_tail(z):
    """Standard normal distribution function by a rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each document: base (array of spans) and the candidates outside them, with their p-values."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", t.alias("t"))
    any_length = lambda least: lambda m, g: F.length(m) >= least
    d = d.select(
        "doc_id",
        F.concat(spans(F.col("t"), ASSIGN, 0, lambda m, g: F.length(g) >= 8), spans(F.col("t"), ACCESS, 1, any_length(16)), spans(F.col("t"), HEX, 2, any_length(32), LONG_HEX)).alias("base"),
        spans(F.col("t"), CANDIDATE, 3, any_length(20)).alias("runs"),
    )
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    d = cut(d.select("doc_id", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).alias("base"), apart.alias("runs")))

    def rated(r):
        s = statistics(r["run"])
        return F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), s.alias("s"))

    def with_p(r):
        s = r["s"]
        df = s["size"] - 1
        even = (s["chi"] - (df + s["n"] * s["excess"])) / F.sqrt(2 * (df + 2 * s["n"] * s["excess"]))
        z = F.coalesce((even + (CHANGES * s["n"] - s["changes"]) / F.sqrt(CHANGES * s["n"])) / 2**0.5, even)
        return F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), F.greatest(lower_tail(z), F.lit(1e-30)).alias("p"), s["battery"].alias("battery"))

    return cut(d.select("doc_id", "base", F.transform(F.transform("runs", rated), with_p).alias("runs")))


def threshold(rated: DataFrame, rate: float) -> float:
    """The largest bin edge p with p <= rate * (candidates at or below it) / (all candidates); 0 if there is none."""
    each = rated.select(F.explode("runs").alias("r")).select(F.least(F.floor(-F.log10("r.p") * PER_DECADE), F.lit(BINS)).alias("bin"))
    bins = {int(r[0]): int(r[1]) for r in each.groupBy("bin").count().collect()}
    total, below = sum(bins.values()), 0
    best = 0.0
    for b in sorted(bins, reverse=True):  # from the smallest p-values
        below += bins[b]
        edge = 10 ** (-b / PER_DECADE)
        if edge <= rate * below / total:
            best = edge
    return best


def find_secrets(docs: DataFrame, rate: float = 0.01, battery: float = 16.27) -> DataFrame:
    """(doc_id, base, found): arrays of (start, kind, end), base ones alone and with the method's. `battery` is the
    chi-squared limit, at three degrees of freedom, beyond which even symbols are rejected at 0.001."""
    rated = candidates(docs)
    edge = threshold(rated, rate)
    new = F.filter("runs", lambda r: (r["p"] <= edge) & (r["battery"] <= battery))
    new = F.transform(new, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    return rated.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", new)).alias("found"))


def listed(spans_column):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
