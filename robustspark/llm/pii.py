r"""Personal data found with DataFrame functions only.

Regular expressions propose spans, checksum validators confirm them (Luhn for cards, mod 97 for account numbers, ranges
for addresses), and words near a span adjust its score. Positions come from cutting the text at the matches of a kind:
the pieces' lengths and the matches' lengths alternate. All patterns are possessive and start only where a run of their
characters starts or where the last match ended, so every scan is linear in the text, also on long runs of digits.

Base kinds (email, ip, card, phone) are always kept; further kinds (iban, ssn, secret) are kept when their score reaches
``THRESHOLD``. Kinds are found independently and may overlap. Null texts are empty and have no spans; positions are code
points, ends are exclusive; null and repeated ids are kept row by row; no rows give no rows; extra columns are ignored by
the report and kept by the redaction, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import fresh

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

#: A local part runs from its first character, or from where the last match ended, to the @.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators; a run of fewer than 14 or more than 19 digits can't pass.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:password|passwd|secret|token|api_key) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+\"?"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "iban": _IBAN, "ssn": _SSN, "secret": _SECRET}

#: A text without a match of this has no span of the kind.
HINTS = {"email": "@", "phone": "+"}

#: Scores before context, the words that raise them by ``BONUS`` within ``WINDOW`` characters, and the least score kept.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account", "ssn": "ssn|social|security", "secret": "key|token|password|secret|credential",
}
WINDOW, BONUS, THRESHOLD = 40, 0.2, 0.5

#: 0 to 255 with any number of zeros before; the zeros are not possessive, as the number may be a zero itself.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 checksum."""
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether the kind's validator accepts a proposed span."""
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _proposed(kind: str, text: Column) -> Column:
    """The kind's matches in a text."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit(HINTS[kind])), matches).otherwise(F.array().cast("array<string>")) if kind in HINTS else matches


def _placed(kind: str, text: Column, matches: Column) -> Column:
    """Confirmed spans of one kind, scored: array of (start, ord, end, kind, found, score)."""
    pieces = F.split(text, PATTERNS[kind], -1)

    def walk(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(pieces, i))
        return F.struct((start + F.length(F.get(matches, i))).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), walk, lambda s: s["starts"])

    def span(found: Column, start: Column) -> Column:
        end = start + F.length(found)
        before = F.substring(text, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW)))
        around = F.concat(before, F.lit(" "), F.substring(text, end + 1, F.lit(WINDOW)))
        score = F.lit(PRIOR[kind]) + F.when(around.rlike(rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})"), BONUS).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), found.alias("found"), F.least(score, F.lit(1.0)).alias("score"))

    keep = (lambda s: confirmed(kind, s["found"])) if kind in BASE else (lambda s: confirmed(kind, s["found"]) & (s["score"] >= THRESHOLD))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,found:string,score:double>>")
    return F.when(F.size(matches) > 0, F.filter(F.zip_with(matches, starts, span), keep)).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with one more column: the spans of each text by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {kind: fresh(docs, f"spans_{kind}") for kind in KINDS}
    staged = docs.withColumns({own[kind]: _proposed(kind, text) for kind in KINDS})
    staged = staged.withColumns({own[kind]: _placed(kind, text, F.col(own[kind])) for kind in KINDS})
    spans = F.array_sort(F.flatten(F.array(*map(F.col, own.values()))))
    return staged.withColumn(out, spans).drop(*own.values())


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base spans, all spans as a string, highest score."""
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text")
    base = F.filter("pii_spans", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.filter(F.transform("pii_spans", lambda s: s["kind"]), lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]  # noqa: B023
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.array_max(F.transform("pii_spans", lambda s: s["score"])).alias("top_score"))


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first stands for all.

    A null text stays null. ``count_col``, where the table has it, follows the new text.
    """
    text = F.col(text_col)

    def write(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        parts = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, parts).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    finish = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    spans, new = fresh(docs, "spans"), fresh(docs, "redacted")
    out = with_spans(docs, text_col, spans)
    out = out.withColumn(new, F.when(F.size(spans) > 0, F.aggregate(spans, start, write, finish)).otherwise(text))
    changed = {text_col: F.col(new)}
    if count_col in docs.columns:
        changed[count_col] = F.when(F.size(spans) > 0, F.length(new).cast(docs.schema[count_col].dataType)).otherwise(F.col(count_col))
    return out.withColumns(changed).select(*docs.columns)
