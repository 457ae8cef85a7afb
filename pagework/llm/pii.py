"""Personal data by patterns, checksums and context, in column expressions (operator 5).

Patterns propose spans, validators confirm them (ranges of address parts, Luhn,
mod-97, digit counts), and words shortly before a span adjust its score.  Spans
of the base kinds stay whatever their score; kinds the method adds (``iban``,
and ``tel`` for national numbers) need ``least``.

Possessive and anchored forms of the patterns are used where they match the same
spans, so that long runs of one character cost linear time.  Offsets are code
points: a match starts where the lengths of the pieces and matches before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns; same matches as the plain forms in the docstring of ``find``.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,5}[\x20./-]?[0-9]{2,5}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
# Score of a confirmed span, and what a word of its context adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "tel": 0.4}
CONTEXT = {
    "email": "mail|contact|write", "ip": "address|server|host|login|ip",
    "card": "card|visa|master|credit|karte|tarjeta|carte", "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|konto|bank|cuenta|compte", "tel": "phone|call|tel|fax|mobile",
}
BONUS = 0.2
NEAR = 40  # code points before a span that count as its context
LEAST = 0.6
STEP = 256


def _starts(matches: Column, pieces: Column) -> Column:
    """Where each match starts.  Lengths are summed in steps, so that a text with
    n matches costs n * STEP additions."""
    lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(pieces[i]))

    def total(first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(lengths, first, count), F.lit(0), lambda a, x: a + x)

    last = F.floor((F.size(matches) - 1) / STEP).cast("int")
    bases = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.lit(1), b * STEP))
    return F.transform(
        matches,
        lambda m, i: F.element_at(bases, F.floor(i / STEP).cast("int") + 1) + total(i - i % STEP + 1, i % STEP) + F.length(pieces[i]),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a text of digits."""
    figures = F.split(F.reverse(digits), "")

    def weighed(total: Column, d: Column, i: Column) -> Column:
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    numbers = F.transform(figures, lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: weighed(a, x["d"], x["i"])) % 10 == 0


def mod97(account: Column) -> Column:
    """The remainder test of an account number with its country and check digits."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.left(plain, F.lit(4)))

    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    values = F.transform(F.split(turned, ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return digits.between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "tel":
        return digits.between(7, 12)
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column, pieces: Column, starts: Column, least: float) -> Column:
    """Confirmed spans of one kind as structs, with their scores."""
    word = rf"\b(?:{CONTEXT[kind]})"

    def span(m: Column, i: Column) -> Column:
        start = starts[i]
        before = F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
        bonus = F.when(F.lower(before).rlike(word), BONUS).otherwise(0.0)
        return F.struct(
            start.alias("start"), F.lit([*PATTERNS].index(kind)).alias("order"), (start + F.length(m)).alias("end"),
            F.lit(kind).alias("kind"), m.alias("value"), (F.lit(SCORES[kind]) + bonus).alias("score"),
        )

    found = F.filter(F.transform(matches, span), lambda s: _valid(kind, s["value"]))
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= least)


SPANS = "array<struct<start: int, order: int, end: int, kind: string, value: string, score: double>>"


def find(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """Append ``pii``: spans (start, order, end, kind, value, score) sorted by
    start, then kind.  Starts count code points, ends are exclusive.

    Base kinds are leftmost matches that do not overlap within their kind; a match
    whose validator fails is dropped and not retried:
    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip, four numbers
    of at most 255; card ``[0-9]([\\x20-]?[0-9])+`` with 14 to 19 digits that pass
    Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits.  Null and
    empty texts have no spans.  Rows are independent; a column ``pii`` is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    names = [c for c in docs.columns if c != "pii"]
    none = F.expr("cast(array() as array<string>)")
    body = F.coalesce(F.col(text), F.lit(""))
    guarded = docs.select(*kept, body.alias("__text"), body.rlike("[0-9]").alias("__digit"))
    offered = {k: F.contains("__text", F.lit("@")) if k == "email" else F.col("__digit") for k in PATTERNS}
    matched = guarded.select(*[F.col(f"`{c}`") for c in names], "__text", *[
        F.when(offered[k], F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none).alias(f"__m_{k}") for k, p in PATTERNS.items()
    ])
    cut = matched.select("*", *[
        F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(none).alias(f"__p_{k}") for k, p in PATTERNS.items()
    ])
    placed = cut.select("*", *[
        F.when(F.size(f"__m_{k}") > 0, _starts(F.col(f"__m_{k}"), F.col(f"__p_{k}"))).alias(f"__s_{k}") for k in PATTERNS
    ])
    empty = F.expr(f"cast(array() as {SPANS})")
    spans = [
        F.when(F.size(f"__m_{k}") > 0, _spans(k, F.col("__text"), F.col(f"__m_{k}"), F.col(f"__p_{k}"), F.col(f"__s_{k}"), least).cast(SPANS)).otherwise(empty)
        for k in PATTERNS
    ]
    return placed.select(*[F.col(f"`{c}`") for c in names], F.array_sort(F.concat(*spans)).alias("pii"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of the query."""
    found = find(docs.select("doc_id", "text")).select("doc_id", "pii")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [number(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
