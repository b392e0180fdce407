"""Operator 1: format-preserving pseudonyms by Feistel rounds, in DataFrame functions alone.

Payment cards (Luhn), social security numbers, phone numbers, IPv4 addresses, dates and the names of e-mail addresses are found,
validated, and permuted under a key within their own format: separators, lengths and letter classes stay, card numbers pass
Luhn again, numbers and dates stay valid. The same value has the same pseudonym in every document, other values have others,
so links between documents remain. The round function is SHA-256 over key, kind, round and half.

A run of digits can hold several values, or a value beside other numbers. So besides the matches of ALL, every place where a
grouped card, a social security number or a phone number starts is tried, overlaps included, and overlaps are settled after
validation: such a value wins over a card of unusual groups, then the earlier one wins, then the longer one. Values that
further digits are joined to by a hyphen or dot are taken apart for cards and hyphens only, as Luhn's sum tells those.

Nulls and edge cases: a null text stays null, an empty one empty; what fails validation as every kind stays as it is; a value whose
halves are empty is shifted by the key alone; repeated rows give equal rows; extra columns pass through, but one named found is
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("card", "ssn", "phone", "ipv4", "date", "email")
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
PATTERNS = {
    "date": rf"{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}|{_DAY}[-/.]{_DAY}[-/.]{_YEAR}",
    "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{8,15}|1[3-9]\d{9}",
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
}
#: One pattern for all kinds; at one place the first kind of the order below wins.
ALL = r"(?<![A-Za-z0-9_.%+@-])(?:" + "|".join(PATTERNS[k] for k in ("email", "date", "ipv4", "card", "ssn", "phone")) + r")(?![A-Za-z0-9_@]|[.-]\d)"
_AFTER, _BEFORE = r"(?<![A-Za-z0-9_.%+@-])", r"(?![A-Za-z0-9_@]|[.-]\d)"
_CARD_AFTER, _CARD_BEFORE = rf"(?:{_AFTER}|(?<=\d-))", r"(?![A-Za-z0-9_@]|\.\d)"
#: (kind, pattern) tried at every place where one of them starts: whole groups of digits.
_GROUPED = tuple(("card", p) for p in (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{4}(?:[ -]\d{3}){3}", r"\d{6}[ -]\d{7,13}"))
EVERYWHERE = (*((k, rf"{_CARD_AFTER}(?=({p}){_CARD_BEFORE})") for k, p in _GROUPED), *((k, rf"{_AFTER}(?=({PATTERNS[k]}){_BEFORE})") for k in ("ssn", "phone")))
STARTS = r"(?=[\d+(])(?:" + "|".join(p for _, p in EVERYWHERE).replace("(?=(", "(?=(?:") + ")"
_FIRST_DAY = "1900-01-01"
#: Days of 1900 to 2099, and the two halves of a date's number: 229 x 319 is 73,051, two more than there are days.
_DAYS, _DATE_LEFT, _DATE_RIGHT = 73_049, 229, 319
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8


def _pseudorandom(key: str, kind: str, *values):
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[v.cast("string") for v in values])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left, right, left_size, right_size, key: str, kind: str, tweak):
    """Permutes (left, right) with 0 <= left < left_size, 0 <= right < right_size; a struct (l, r)."""

    def one(s, i):
        into_left = F.pmod(s["l"] + F.pmod(_pseudorandom(key, kind, i, tweak, s["r"]), left_size), left_size)
        into_right = F.pmod(s["r"] + F.pmod(_pseudorandom(key, kind, i, tweak, s["l"]), right_size), right_size)
        odd = i % 2 == 1
        return F.struct(F.when(odd, into_left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(into_right).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one)


def _let(value, body):
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _ten(n):
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits, key: str, kind: str, tweak):
    """A digit string (1 to 19 digits) of the same length."""

    def halves(d):
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        l, r = F.substr(d, F.lit(1), a), F.substr(d, a + 1, n)
        out = feistel(F.coalesce(F.try_to_number(F.when(l == "", "0").otherwise(l), F.lit("9" * 19)), F.lit(0)), F.try_to_number(r, F.lit("9" * 19)), _ten(a), _ten(n - a), key, kind, tweak)
        return _let(out, lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, "0")).otherwise(F.lit("")), F.lpad(s["r"].cast("string"), n - a, "0")))

    return _let(digits, halves)


def only_digits(value):
    return F.regexp_replace(value, r"\D", "")


def into_places(value, digits):
    """`digits` in the places of the digits of `value`."""
    place = lambda i: F.length(only_digits(F.substr(value, F.lit(1), i)))
    each = lambda i: F.when(F.substr(value, i, F.lit(1)).rlike(r"\d"), F.substr(digits, place(i), F.lit(1))).otherwise(F.substr(value, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), each), "")


def luhn_sum(digits, doubled_first):
    """Luhn's sum over a digit string; doubled_first tells whether the last digit is doubled."""

    def term(ch, i):
        d = ch.cast("int")
        twice = (i + F.when(doubled_first, F.lit(0)).otherwise(F.lit(1))) % 2 == 0
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x)


def is_card(digits):
    return F.length(digits).between(13, 19) & (luhn_sum(digits, F.lit(False)) % 10 == 0) & ~digits.rlike(r"^(\d)\1*$")


def card(value, key: str):
    body = permute_digits(F.substr(only_digits(value), F.lit(1), F.length(only_digits(value)) - 1), key, "card", F.lit(""))
    return _let(body, lambda b: into_places(value, F.concat(b, ((10 - luhn_sum(b, F.lit(True)) % 10) % 10).cast("string"))))


def is_ssn(digits):
    return ~digits.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")


def ssn(value, key: str):
    """Permuted among the valid numbers: 898 areas (not 000, 666 or 9xx) by 99 x 9,999 others."""

    def of(d):
        n = lambda i, size: F.substr(d, F.lit(i), F.lit(size)).cast("long")
        area = n(1, 3) - F.when(n(1, 3) > 666, 2).otherwise(1)
        other = (n(4, 2) - 1) * 9999 + n(6, 4) - 1
        moved = feistel(area, other, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "ssn", F.lit(""))
        pad = lambda x, size: F.lpad(x.cast("string"), size, "0")
        return _let(moved, lambda s: into_places(value, F.concat(pad(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))))

    return _let(only_digits(value), of)


def phone(value, key: str):
    """A mobile number keeps its first two digits, any other number all but the last seven, whose first digit stays among 0 and
    1 or among 2 to 9; what stays is the tweak."""

    def of(d):
        mobile = value.rlike(r"^1[3-9]\d{9}$")
        head = F.substr(d, F.lit(1), F.when(mobile, 2).otherwise(F.length(d) - 7))
        rest = F.substr(d, F.length(head) + 1, F.lit(9))
        high = F.substr(rest, F.lit(1), F.lit(1)) >= "2"
        base, size = F.when(high, 2_000_000).otherwise(0).cast("long"), F.when(high, 8_000).otherwise(2_000).cast("long")
        n = rest.cast("long") - base
        moved = feistel(F.floor(n / 1000), n % 1000, size, F.lit(1000).cast("long"), key, "phone", head)
        seven = _let(moved, lambda s: F.lpad((s["l"] * 1000 + s["r"] + base).cast("string"), 7, "0"))
        return into_places(value, F.concat(head, F.when(mobile, permute_digits(rest, key, "phone", head)).otherwise(seven)))

    return _let(only_digits(value), of)


def is_ipv4(value):
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def ipv4(value, key: str):
    def of(o):
        n = lambda i: o[i].cast("long")
        big = F.lit(65536).cast("long")
        return _let(feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), big, big, key, "ipv4", F.lit("")), lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))

    return _let(F.split(value, r"\."), of)


def date_order(value):
    """0: year first, 1: day first, 2: month first; null: no valid date."""
    p = F.split(value, "[-/.]")
    valid = lambda y, m, d: F.try_to_date(F.concat_ws("-", p[y], p[m], p[d]), "yyyy-MM-dd").isNotNull()
    return F.when(F.length(p[0]) == 4, F.when(valid(0, 1, 2), 0)).when(valid(2, 1, 0), 1).when(valid(2, 0, 1), 2)


def permute_day(n, key: str):
    """A day's number among all days. A number behind the last day is permuted again until it is a day's (cycle walking); there
    are two such numbers, so three steps are enough."""

    def step(x):
        moved = feistel(F.floor(x / _DATE_RIGHT), x % _DATE_RIGHT, F.lit(_DATE_LEFT).cast("long"), F.lit(_DATE_RIGHT).cast("long"), key, "date", F.lit(""))
        return _let(moved, lambda m: m["l"] * _DATE_RIGHT + m["r"])

    again = lambda x: F.when(x < _DAYS, x).otherwise(step(x))
    return _let(step(n), lambda x: _let(again(x), again))


def date(value, key: str):
    def of(s):
        p, order = s["p"], s["o"]
        at = lambda a, b, c: F.when(order == 0, p[a]).when(order == 1, p[b]).otherwise(p[c])
        day = F.try_to_date(F.concat_ws("-", at(0, 2, 2), at(1, 1, 0), at(2, 0, 1)), "yyyy-MM-dd")
        n = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
        shown = lambda x, form: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int")), form)
        return _let(permute_day(n, key), lambda x: into_places(value, F.when(order == 0, shown(x, "yyyyMMdd")).when(order == 1, shown(x, "ddMMyyyy")).otherwise(shown(x, "MMddyyyy"))))

    return _let(F.struct(F.split(value, "[-/.]").alias("p"), date_order(value).alias("o")), of)


def permute_letters(value, key: str, tweak):
    """Feistel rounds over the two halves of a string; letters and digits stay in their class, others stay as they are."""

    def shifted(s, other, i):
        def one(ch, at):
            r = _pseudorandom(key, "letters", i, tweak, at, other)
            move = lambda a: F.substr(F.lit(a), (F.pmod(F.instr(F.lit(a), ch) - 1 + F.pmod(r, F.lit(len(a))), F.lit(len(a))) + 1).cast("int"), F.lit(1))
            return F.when(ch.rlike("^[a-z]$"), move(_LOWER)).when(ch.rlike("^[A-Z]$"), move(_UPPER)).when(ch.rlike("^[0-9]$"), move(_DIGITS)).otherwise(ch)

        return F.array_join(F.transform(F.split(s, ""), one), "")

    def step(s, i):
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.concat(s["l"], s["r"]))


def email(value, key: str):
    """The name is permuted in lower case and takes its capitals back, so that an address is linked in either case."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    capital = lambda ch, i: F.when(F.substr(name, i + 1, F.lit(1)).rlike("^[A-Z]$"), F.upper(ch)).otherwise(ch)
    moved = F.array_join(F.transform(F.split(permute_letters(F.lower(name), key, F.lower(host)), ""), capital), "")
    return F.concat(moved, F.lit("@"), host)


def kind_of(value):
    """The kind of a match, null where validation fails."""
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(whole("email"), "email").when(whole("date"), F.when(date_order(value).isNotNull(), "date")).when(whole("ipv4"), F.when(is_ipv4(value), "ipv4"))
        .when(whole("ssn"), F.when(is_ssn(only_digits(value)), "ssn")).when(whole("card") & is_card(only_digits(value)), "card").when(whole("phone"), "phone")
    )


def pseudonym(value, kind, key: str):
    out = F.when(kind == "card", card(value, key))
    for name, f in (("ssn", ssn), ("phone", phone), ("ipv4", ipv4), ("date", date), ("email", email)):
        out = out.when(kind == name, f(value, key))
    return out.otherwise(value)


def _candidates(text):
    """Arrays of (start, back, end, m, kind, loose): all valid values of a text, overlapping ones too; back is -end."""

    def of(start, m, kind, loose):
        end = (start + F.length(m)).cast("int")
        return F.struct(start.cast("int").alias("start"), (-end).alias("back"), end.alias("end"), m.alias("m"), kind.alias("kind"), loose.alias("loose"))

    def ends(lengths):
        """Running sums."""
        none = F.expr("CAST(array() AS array<int>)")
        return F.aggregate(lengths, none, lambda a, n: F.array_append(a, F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + n))

    matches = F.regexp_extract_all(text, F.lit(ALL), F.lit(0))
    lengths = F.zip_with(F.split(text, ALL, -1), matches, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    loose = lambda m, kind: (kind == "card") & ~m.rlike("^(?:" + "|".join(p for k, p in _GROUPED if k == "card") + ")$")
    first = F.zip_with(matches, F.slice(ends(lengths), F.lit(1), F.size(matches)), lambda m, end: _let(kind_of(m), lambda k: of(end - F.length(m), m, k, loose(m, k))))
    # one place before the text, as a split leaves out an empty first piece
    led = F.concat(F.lit("\n"), text)
    at = _let(ends(F.transform(F.split(led, STARTS, -1), F.length)), lambda a: F.slice(a, 1, F.size(a) - 1))

    def tried(kind, pattern):
        test = {"card": lambda m: is_card(only_digits(m)), "ssn": lambda m: is_ssn(only_digits(m)), "phone": lambda m: F.lit(True)}[kind]
        values = F.regexp_extract_all(led, F.lit(f"{STARTS}(?:{pattern}|)"), F.lit(1))
        return F.zip_with(at, values, lambda a, m: of(a - 1, m, F.when((m != "") & test(m), kind), F.lit(False)))

    more = [tried(*x) for x in EVERYWHERE]
    return F.filter(F.concat(first, *more), lambda x: x["kind"].isNotNull())


def pseudonymise(docs: DataFrame, key: str = "quire") -> DataFrame:
    """docs with the new text, and found: array of (start, end, kind, pseudonym) with places in the old text's code points.

    Only texts with a match are taken apart; the others cost one pass of either pattern.
    """
    t = F.col("text")
    some = F.regexp_like(t, F.lit(ALL)) | F.regexp_like(t, F.lit(STARTS))
    d = docs.withColumn("_pseudonyms_all", F.when(some, _candidates(t)))
    apart = F.filter("_pseudonyms_all", lambda x: ~(x["loose"] & F.exists("_pseudonyms_all", lambda y: ~y["loose"] & (y["start"] < x["end"]) & (y["end"] > x["start"]))))
    d = d.withColumn("_pseudonyms_all", F.array_sort(apart))
    none = F.slice("_pseudonyms_all", 1, 0)
    settled = F.aggregate("_pseudonyms_all", none, lambda a, x: F.when(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1)["end"], F.lit(0)) <= x["start"], F.array_append(a, x)).otherwise(a))
    d = d.withColumn("_pseudonyms_all", settled)
    made = F.transform("_pseudonyms_all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("pseudonym")))
    d = d.withColumn("found", F.coalesce(made, F.expr("CAST(array() AS array<struct<start:int,end:int,kind:string,pseudonym:string>>)"))).drop("_pseudonyms_all")
    end = lambda i: F.coalesce(F.when(i > 0, F.get("found", i - 1)["end"]), F.lit(0))
    parts = F.transform("found", lambda x, i: F.concat(F.substr(t, end(i) + 1, x["start"] - end(i)), x["pseudonym"]))
    rest = F.substr(t, end(F.size("found")) + 1, F.length(t))
    return d.withColumn("text", F.when(F.size("found") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return d.select("doc_id", *[count(k) for k in KINDS], spans.alias("spans"), "text")
