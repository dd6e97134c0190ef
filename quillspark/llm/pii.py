"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

DataFrame functions only. Positions are code points. A JVM regular expression that repeats a group
recurses once for each turn, so separators that lie between two digits (or two label characters) are
first replaced one for one by marks; a chain is then one character class, and no text is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
#: Code points before a span in which a context word counts.
CONTEXT = 40
#: Score in hundredths without context, and what a context word adds.
PRIOR = {"email": 80, "ip": 50, "card": 70, "phone": 50, "iban": 80}
CONTEXT_ADDS = 20
WORDS = {
    "email": "mail|contact|write to|correo|courriel",
    "ip": "ip|host|address|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell|whatsapp",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
}

_LOCAL = r"A-Za-z0-9._%+\x02-"
PATTERNS = {
    # \x02: a dot between two label characters. A match can only begin where a run begins or where
    # the previous match ended; anything else would rescan the run for each of its characters.
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # \x01: a space or hyphen between two digits.
    "card": r"[0-9][0-9\x01]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}


def _marked(text: Column, separators: str, around: str, mark: str) -> Column:
    """``text`` with each separator that stands between two ``around`` characters replaced by ``mark``."""
    free = F.translate(text, mark, "\x03")
    return F.regexp_replace(free, f"(?<=[{around}]){separators}(?=[{around}])", mark)


def _spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<s,e,v>>: the pieces between matches give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, found, lambda g, v: F.struct(F.char_length(g).alias("g"), v.alias("v")))
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def step(acc, x):
        s = acc["p"] + x["g"]
        e = s + F.coalesce(F.char_length(x["v"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))
        return F.struct(e.alias("p"), F.when(x["v"].isNull(), acc["o"]).otherwise(F.concat(acc["o"], one)).alias("o"))

    return F.aggregate(both, F.struct(F.lit(0).alias("p"), none.alias("o")), step, lambda a: a["o"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.char_length(digits)

    def step(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return acc + F.when(twice & (d > 4), d * 2 - 9).when(twice, d * 2).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), step) == 1


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(v, "[.]"), lambda p: (F.char_length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(v)
        return F.char_length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.char_length(_digits(v)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(v, F.lit(" "), F.lit("")))
    return F.lit(True)


def _kept(text: Column, spans: Column, k: int) -> Column:
    """The confirmed spans of kind ``k`` with their scores."""
    kind = KINDS[k]

    def scored(x):
        at = F.greatest(x["s"] - CONTEXT, F.lit(0))
        near = F.substring(text, at + 1, x["s"] - at).rlike(rf"(?i)(?<![a-z])(?:{WORDS[kind]})")
        score = F.lit(PRIOR[kind]) + F.when(near, CONTEXT_ADDS).otherwise(0)
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), score.alias("score"))

    return F.transform(F.filter(spans, lambda x: _valid(kind, x["v"])), scored)


def find_spans(text: Column) -> Column:
    """array<struct<s,k,e,score>> of all confirmed spans, by start, then kind; k indexes ``KINDS``.

    A cheap test keeps the expensive patterns off the texts that can't hold a match.
    """
    source = {
        "email": (text.contains("@"), _marked(text, r"\.", "A-Za-z0-9-", "\x02")),
        "ip": (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), text),
        "card": (text.rlike(r"[0-9](?:[ -]?[0-9]){11}"), _marked(text, "[ -]", "0-9", "\x01")),
        "phone": (text.contains("+"), text),
        "iban": (text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), text),
    }
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,score:int>>)")
    parts = []
    for k, kind in enumerate(KINDS):
        likely, subject = source[kind]
        parts.append(F.when(likely, _kept(text, _spans(subject, PATTERNS[kind]), k)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``found``, the confirmed spans.

    A null text is empty and has none; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored. A
    very long text is searched whole, in time that grows with its length times its matches.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return d.select("doc_id", find_spans(F.col("t")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, base digest, span list and scores of ``detect``'s rows."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")

    f = F.col("found")
    of = lambda k: F.size(F.filter(f, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [of(k) for k in range(len(KINDS))]
    return found.select(
        "doc_id", *counts[:4],
        F.sha2(joined(F.filter(f, lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"),
        joined(f).alias("spans"), counts[4],
        F.array_join(F.transform(f, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return digest(detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))
