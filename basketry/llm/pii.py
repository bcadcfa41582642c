"""Personal data spans, in DataFrame functions only.

Regular expressions propose spans, validators (octet range, Luhn, digit counts, mod-97)
confirm them and words nearby move their score. Spans of the base kinds always stay; spans
that the method adds (``iban``, short cards, phones without a plus) need a score of at least
``LEAST`` and may not overlap a base span. Positions are code points, ends exclusive.

Patterns never restart inside a run that has already failed, and unbounded groups repeat
possessively, so a long run of digits or letters is read once and needs no deep stack.

Defined cases: null text counts as empty and has no spans; repeated rows get the same spans;
an empty table gives no rows. Input columns ``pii_base``, ``pii_added`` and those that begin
with ``__pii`` give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "local_phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Each finds the leftmost non-overlapping matches; a match begins where its run begins or
#: where the match before ended (\G).
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "local_phone": "(?<![0-9A-Za-z+().-])(?<![0-9][\\x20.-])\\(?[0-9]{2,4}\\)?[\\x20.-][0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9]|[\\x20.-][0-9])",
}
#: Score before context, and words that raise it if they stand within CONTEXT code points.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "local_phone": 0.3}
WORDS = {
    "email": "e-?mail|contact|write",
    "ip": "\\bip\\b|address|host|server",
    "card": "card|visa|master|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|tél",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "short_card": "card|visa|amex|credit|debit|karte|carte|tarjeta",
    "local_phone": "phone|tel|call|mobile|fax|tél",
}
CONTEXT, RAISE, LEAST = 40, 0.3, 0.5


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all matches: the pieces between them give places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(got: Column):
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(got["p"][i])
            end = start + F.length(got["m"][i])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), got["m"][i].alias("match"))).alias("out"))

        return add

    def place(got: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(got["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(got["m"]) - 1), first, step(got), lambda acc: acc["out"])).otherwise(empty)

    return common.let(F.struct(found.alias("m"), pieces.alias("p")), place)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.split(F.reverse(number), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 modulo 97, with its first four characters moved to the end."""
    bare = F.regexp_replace(iban, "\\x20", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind. Cheap conditions keep patterns off texts that can't match."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    if_in = lambda condition, spans: F.when(condition, spans).otherwise(empty)
    digit = text.rlike("[0-9]")
    octets = lambda m: F.forall(F.split(m, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, "\\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    n = lambda m: F.length(digits(m))
    runs = if_in(text.rlike("[0-9](?:[\\x20-]?[0-9]){12}"), located(text, PATTERNS["card"]))
    return {
        "email": if_in(F.contains(text, F.lit("@")), located(text, PATTERNS["email"])),
        "ip": if_in(text.rlike("[0-9]\\.[0-9]"), F.filter(located(text, PATTERNS["ip"]), lambda s: octets(s["match"]))),
        "card": F.filter(runs, lambda s: n(s["match"]).between(16, 19) & luhn(digits(s["match"]))),
        "phone": if_in(F.contains(text, F.lit("+")), F.filter(located(text, PATTERNS["phone"]), lambda s: n(s["match"]).between(8, 15))),
        "iban": if_in(digit, F.filter(located(text, PATTERNS["iban"]), lambda s: mod97(s["match"]))),
        "short_card": F.filter(runs, lambda s: n(s["match"]).between(13, 15) & luhn(digits(s["match"]))),
        "local_phone": if_in(digit, located(text, PATTERNS["local_phone"])),
    }


def scored(text: Column, kind: str, spans: Column) -> Column:
    """Spans with their kind and score; a word of the kind nearby raises the score."""

    def score(s: Column) -> Column:
        from_ = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.substring(text, from_ + 1, s["start"] - from_)
        after = F.substring(text, s["end"] + 1, F.lit(CONTEXT))
        hit = F.lower(near).rlike(WORDS[kind]) | F.lower(after).rlike(WORDS[kind])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(hit, RAISE).otherwise(0.0)).alias("score"))

    return F.transform(spans, score)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_added``: arrays of (kind, start, end, score), base kinds
    in the order of KINDS, each kind by start."""
    own = docs.withColumn("__pii_t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__pii_t")
    own = own.withColumns({f"__pii_{k}": v for k, v in proposals(t).items()})
    own = own.withColumn("pii_base", F.concat(*[scored(t, k, F.col(f"__pii_{k}")) for k in KINDS]))
    clear = lambda s: ~F.exists(F.col("pii_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.concat(*[scored(t, k, F.col(f"__pii_{k}")) for k in ADDED])
    own = own.withColumn("pii_added", F.filter(added, lambda s: (s["score"] >= LEAST) & clear(s)))
    return own.drop("__pii_t", *[f"__pii_{k}" for k in (*KINDS, *ADDED)])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each line's spans masked as ``[KIND]``: the text is cut at span ends
    and put together again, later spans first."""
    own = with_spans(docs, text)
    latest = F.reverse(F.array_sort(F.transform(F.concat("pii_base", "pii_added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    mask = lambda x, s: F.when(s["end"] > x["upto"], x).otherwise(F.struct(F.concat(F.substring(x["t"], F.lit(1), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substring(x["t"], s["end"] + 1, F.length(x["t"]))).alias("t"), s["start"].alias("upto")))
    first = F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"), F.lit(2**31 - 1).alias("upto"))
    return own.withColumn(text, F.when(F.col(text).isNull(), None).otherwise(F.aggregate(latest, first, mask, lambda x: x["t"]))).drop("pii_base", "pii_added")
