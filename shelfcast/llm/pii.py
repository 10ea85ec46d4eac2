"""Personal data: regular expressions propose spans, checks confirm them, and
nearby words adjust their score.

A kind has a pattern, a check (part range, digit count, Luhn, mod-97) and a
first score.  A context word of the kind in the `CONTEXT` characters before or
after a span adds `BOOST`; spans scoring `KEEP_FROM` or more are kept.  The base kinds
(email, ip, card, phone) begin above that, so context never removes one; an
ssn-like number needs its context.

Patterns are written so that Java's engine runs over any text in linear time
and bounded stack: runs start only where no run precedes them (or where the
previous match ended), and repeated groups are possessive or bounded.  A match
that fails its check is dropped without a second try.

Only DataFrame functions run, and each row's spans are found within the row: no
shuffle, and nothing is gathered but the spans of one text.

Defined results.  Null text: as the empty text, no spans (and it stays null in
`redact`).  Null doc_id and repeated rows: one result each.  Other columns are
ignored by `find`, and pass through `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOST = 0.3
KEEP_FROM = 0.5
CONTEXT = 40


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i))
    return total % 10 == 0


def _mod97(value: Column) -> Column:
    packed = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))
    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(low, high)


def _always(value: Column) -> Column:
    return F.lit(True)


# The countries of each IBAN length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
# A country's own length, so that no following word is taken for a part.
IBAN = (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
    + r")(?![A-Za-z0-9])")

# Kind, cheap test that a text may hold one, pattern, check, first score,
# words of its context.  The first four are the base kinds, in their order.
KINDS: tuple[tuple[str, str, str, Callable[[Column], Column], float, str], ...] = (
    ("email", "@",
     r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
     _always, 0.9, "mail|contact|write"),
    ("ip", r"[0-9]\.[0-9]+\.[0-9]",
     r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
     lambda v: v.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"),
     0.6, r"\bip\b|address|host|server"),
    ("card", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]",
     r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
     _luhn, 0.8, "card|visa|credit|debit|karte|carte|tarjeta"),
    ("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", _digits(8, 15), 0.7, "phone|call|tel|mobile|fax"),
    ("iban", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
     IBAN, _mod97, 0.9, "iban|account|bank|konto|compte|cuenta"),
    ("ssn", "[0-9]-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
     lambda v: ~v.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"), 0.3, "ssn|social|security"),
)
BASE = tuple(k[0] for k in KINDS[:4])


def _places(text: Column, rx: str) -> Column:
    """array<struct<start, end, value>> of the matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rx), 0)
    # The pieces between matches tell where each match begins.
    both = F.zip_with(F.slice(F.split(text, rx, -1), F.lit(1), F.size(found)), found,
                      lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _scored(text: Column, kind: tuple) -> Column:
    """array<struct<kind, start, end, score>> of one kind's kept spans."""
    name, hint, rx, check, first, words = kind
    near = lambda p: F.concat(F.substring(text, F.greatest(p["start"] - CONTEXT, F.lit(0)) + 1,
                                          F.least(p["start"], F.lit(CONTEXT))), F.lit("\n"),
                              F.substring(text, p["end"] + 1, F.lit(CONTEXT)))
    may = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    spans = F.transform(F.filter(_places(text, rx), lambda p: check(p["value"])), lambda p: F.struct(
        F.lit(name).alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
        F.least(F.lit(1.0), F.lit(first) + F.when(F.lower(near(p)).rlike(words), F.lit(BOOST)).otherwise(F.lit(0.0)))
        .alias("score")))
    return F.filter(F.when(may, spans).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")), lambda s: s["score"] >= KEEP_FROM)


def with_spans(docs: DataFrame, prefix: str = "_pii_") -> DataFrame:
    """`docs` with a column of scored spans per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({f"{prefix}{k[0]}": _scored(text, k) for k in KINDS})


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, all spans
    as text, and the best score."""
    found = with_spans(docs.select("doc_id", "text"))
    every = F.concat(*[F.col(f"_pii_{k[0]}") for k in KINDS])
    base = F.concat(*[F.col(f"_pii_{k}") for k in BASE])
    return found.select(
        "doc_id", *[F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of a text replaced by its kind in brackets;
    overlapping spans become one.  `n_chars` follows the text where present."""
    # The row is one column here, so that no name of it meets one of these.
    found = with_spans(docs.select(F.struct("*").alias("doc"), "text"))
    every = F.array_sort(F.transform(F.concat(*[F.col(f"_pii_{k[0]}") for k in KINDS]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(
            acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(every, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    hit = F.size(F.concat(*[F.col(f"_pii_{k[0]}") for k in KINDS])) > 0
    shown = found.select("doc", hit.alias("hit"), F.when(hit, clean).otherwise(F.col("text")).alias("clean"))
    out = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return shown.select(*[out.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
