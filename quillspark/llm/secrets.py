"""Secret scans: three fixed patterns, and values in a credential's context that are costly to guess.

The guess cost of a value is the least total of a segmentation into known words, dates, repeats, keyboard
walks, runs of neighbouring characters, and brute-force spans: log10 of the guesses that an attacker who
knows the segments' kinds would need. Weak placeholders ("changeme", "password2024") stay below the bar. Words
and their ranks come from the scanned texts themselves, in whatever language, and from the vocabularies of public
tokenizers, beside a short list here. What only refers to a value (a path, a variable, a call) is no value.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, cut, map_rows

KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]
#: log10 guesses from which a value in a credential's context is a secret, and its shortest length.
COST, SHORTEST = 10.0, 8
#: log10 guesses from which a value's cost isn't told exactly: whatever follows, it needs as many.
ENOUGH = 40.0
#: Characters of a word, date, walk or run, and of a repeated block, at most: longer walks count as several.
SEGMENT = 24
#: Vocabularies whose words come in order of their frequency, nearly: a JSON file of a tokenizer with word ends, and
#: base64 tokens with ranks. A file that isn't there is an error.
VOCABULARIES = ("/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Documents that a word of the texts is in, at least; words of the texts that are told, the commonest first; words that a task counts before it sends them on.
LEAST, MOST, ENTRIES = 5, 50_000, 200_000

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|access[_-]?key|bearer)["']?(?:\x20{0,8}(?::|=>?)\x20{0,8}|\x20is\x20)["']?([^\s"'<>,;]+)"""
)
#: Letters alone between white space, but for punctuation at the ends.
_PLAIN = re.compile(r"""(?<!\S)[("']*([^\W\d_]{3,24})[.,;:!?)"']*(?!\S)""")
#: A value that is a reference: a variable or template, a path, an address with a place in it, a call or an item of a name, dotted names.
_REFERENCE = re.compile(
    r"""(?a:\$\{?\w+\}?|%\w+%|\{\{.*|<.*|(?:~|\.{1,2})?/[\w./-]*|[\w.-]+\.\w{1,4}|[a-z][\w+-]*://[^:@\s]*|[a-z][a-z0-9.-]*(?::\d{1,5})(?:/\S*)?|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*[\[(].*|(?:[A-Za-z_]+\.)+[A-Za-z_]+)[.)\]]*\Z"""
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")

# Common words of passwords and placeholders, most common first.
WORDS = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "secret", "qwerty", "iloveyou", "princess",
    "football", "baseball", "sunshine", "shadow", "superman", "batman", "trustno1", "hello", "freedom", "whatever", "starwars", "ninja",
    "changeme", "change", "default", "example", "sample", "test", "demo", "user", "guest", "root", "temp", "placeholder", "your", "my",
    "the", "and", "key", "token", "api", "pass", "here", "none", "null", "true", "false", "value", "string", "config", "summer",
    "winter", "spring", "autumn", "monday", "friday", "january", "december", "love", "money", "google", "internet", "computer", "server",
    "service", "database", "public", "private", "access", "account", "project", "secure", "system", "office", "company", "house",
    "production", "staging", "development", "localhost", "postgres", "postgresql", "mysql", "mongodb", "redis", "oracle", "docker", "kubernetes",
    "jenkins", "github", "gitlab", "amazon", "azure", "windows", "ubuntu", "linux", "apache", "backup", "support", "manager", "testing",
)
#: The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("4@301!$57", "aaeoiisst")
_PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d)\Z")
_YEAR = re.compile(r"(?:19|20)\d\d\Z")


def corpus_words(docs: DataFrame, least: int = LEAST, most: int = MOST) -> list[str]:
    """Words of all texts of ``docs`` that stand alone in ``least`` documents, the commonest first, at most ``most`` of them (a bound on what the driver gets).

    Words of equal counts go together, in or out. Each task counts its documents before anything is shuffled. What holds a digit or a sign is no word, so few credentials are.
    """
    from collections import Counter

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(set(_PLAIN.findall((t.as_py() or "").lower())))
                if len(held) >= ENTRIES:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    arrow_batches(docs.sparkSession)
    n = cut(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    told, bar = 0, None
    for r in sorted(n.groupBy("n").count().collect(), key=lambda r: -r["n"]):  # a row for each number of documents
        told += r["count"]
        if told > most:
            break
        bar = r["n"]
    return [] if bar is None else [r["word"] for r in sorted(n.filter(F.col("n") >= bar).collect(), key=lambda r: (-r["n"], r["word"]))]


def ranks(paths: tuple[str, ...] = VOCABULARIES, words: tuple[str, ...] | list[str] = ()) -> dict[str, int]:
    """Words of three letters or more by rank: the list here, then ``words`` and those of the files, the commonest of each in turn. A file that is missing is an error."""
    found: dict[str, int] = {}
    for path in paths:
        with open(path, "rb") as f:
            if path.endswith(".json"):
                got = ((w[:-4], k) for w, k in json.load(f)["model"]["vocab"].items() if w.endswith("</w>"))
            else:
                got = [(base64.b64decode(w)[1:].decode("latin-1").lower(), int(k)) for w, k in map(bytes.split, f) if base64.b64decode(w)[:1] == b" "]
        for w, k in got:
            if re.fullmatch(r"[a-z]{3,}", w):
                found[w] = min(found.get(w, k), k)
    out = {w: k + 1 for k, w in enumerate(WORDS)}
    for a, b in itertools.zip_longest(words, sorted(found, key=lambda w: (found[w], w))):
        for w in (a, b):
            if w is not None:
                out.setdefault(w, len(out) + 1)
    return out


@functools.cache
def _ranks() -> dict[str, int]:
    return ranks()


def _brute(c: str) -> float:
    if c.isdigit() and c.isascii():
        return 1.0
    if c in "-_.":
        return 0.5
    return math.log10(26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _word(s: str, low: str, rank: int, more: float) -> float:
    capital = 0.0 if s == low else 0.3 if s == low.capitalize() or s == s.upper() else 1.0
    return math.log10(rank + 1) + capital + more


def _date(s: str) -> float:
    if _YEAR.match(s):
        return math.log10(200)
    return math.log10(365 * 200) + (0.6 if not s.isdigit() else 0.0) if _DATE.match(s) else math.inf


def _segments(v: str, known: dict[str, int]):
    """A function of e: (length, cost) of the segments that end at e and are words, dates, runs of neighbouring characters or keyboard walks."""
    low = v.lower()
    low = low if len(low) == len(v) else "".join(c.lower() if len(c.lower()) == 1 else c for c in v)
    leet = low.translate(_LEET)
    longest = min(SEGMENT, max(map(len, known), default=0))
    place = [_PLACE.get(c) for c in low]
    near = [False] + [bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1) for p, q in zip(place, place[1:], strict=False)]
    step = [0] + [ord(b) - ord(a) for a, b in zip(v, v[1:], strict=False)]

    def ending(e: int):
        for n in range(2, min(longest, e) + 1):
            w = low[e - n : e]
            if (r := known.get(w)) is not None:
                yield n, _word(v[e - n : e], w, r, 0.0)
            x = leet[e - n : e]
            if x != w and (r := known.get(x)) is not None:
                yield n, _word(v[e - n : e], w, r, 0.6)
        if v[e - 1].isdigit():
            for n in range(4, min(10, e) + 1):
                if v[e - n].isdigit() and (c := _date(v[e - n : e])) < math.inf:
                    yield n, c
        n, d = 2, step[e - 1] if e > 1 else 0
        while abs(d) == 1 and n < min(SEGMENT, e) and step[e - n] == d:
            n += 1
            yield n, math.log10(26 * 2 * n)
        n, turns, way = 1, 1, None
        while n < min(SEGMENT, e) and near[e - n]:
            p, q = place[e - n - 1], place[e - n]
            before, way = way, (q[0] - p[0], q[1] - p[1])
            turns += before is not None and before != way
            n += 1
            if n >= 3:
                yield n, math.log10(40) + turns * math.log10(5) + math.log10(n)

    return ending


def guess_cost(value: str, known: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses for ``value``: the cheapest segmentation, by dynamic programming from left to right.

    A block that is repeated counts once, and how often; of a run of equal blocks all are taken, or all but the first
    one or two, which may belong to what stands before. Once every place that a segment could still begin at has
    cost ``enough``, that is the answer.
    """
    n = len(value)
    ending = _segments(value, _ranks() if known is None else known)
    cost = [0.0] + [math.inf] * n
    plain = [0.0]  # brute force up to here
    for c in value:
        plain.append(plain[-1] + _brute(c))
    same = [0] * (SEGMENT + 1)  # by distance: characters up to here that equal those so far before
    alone: list[dict[int, float]] = [{} for _ in range(n + 1)]  # by end and length: a segment's own cost
    dear = 0  # places in a row up to here that cost enough
    for e in range(1, n + 1):
        best = cost[e - 1] + plain[e] - plain[e - 1]
        for m, c in ending(e):
            alone[e][m] = min(c, alone[e].get(m, math.inf))
            best = min(best, cost[e - m] + 0.3 + c)
        cheap = False
        last = value[e - 1]
        for m in range(1, min(SEGMENT, e - 1) + 1):
            if value[e - 1 - m] != last:
                same[m] = 0
                continue
            same[m] += 1
            k = same[m] // m + 1  # equal blocks that end here
            if k == 1:
                continue
            once = min(plain[e] - plain[e - m], alone[e].get(m, math.inf))
            for j in range(max(2, k - 2), k + 1):
                best = min(best, cost[e - j * m] + 0.3 + once + math.log10(j))
                cheap |= cost[e - j * m] < enough
        cost[e] = best
        if e > 2 * SEGMENT:
            alone[e - 2 * SEGMENT] = {}
        dear = dear + 1 if best >= enough else 0
        if dear > 3 * SEGMENT and not cheap:
            return enough
    return cost[n]


def spans(text: str | None, known: dict[str, int] | None = None) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, cost) by start, then kind; a guess that touches a base span adds nothing and is left out. ``known``: words by rank."""
    if not text:
        return []
    found = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        found += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(text)]
    if hinted:
        held: list[tuple[int, int]] = []  # the base spans, merged where they overlap
        for s, _, e, _ in sorted(found, key=lambda x: x[:3]):
            if held and s < held[-1][1]:
                held[-1] = held[-1][0], max(e, held[-1][1])
            else:
                held.append((s, e))
        for m in _CONTEXT.finditer(text):
            s, e = m.span(1)
            i = bisect.bisect_left(held, (e,)) - 1  # the last that begins before the end
            if e - s >= SHORTEST and not (i >= 0 and held[i][1] > s) and not _REFERENCE.match(text, s, e) and (c := guess_cost(text[s:e], known, ENOUGH)) >= COST:
                found.append((s, 3, e, c))
    return sorted(found, key=lambda x: x[:3])


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(_ITEM))])


def scan(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """Per row of ``docs``: doc_id and found, its spans (kind, start, end, cost) in order; costs are told up to ENOUGH.

    A null text is empty and has none; texts are scanned whole, in time that grows with their length; repeated rows
    give repeated results; an empty table gives an empty result; other columns are ignored. Words are counted over all
    texts first, and told with those of the files, which the driver reads (under 100,000 words in all).
    """
    arrow_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(ranks(vocabularies, corpus_words(docs)))

    def rows(cols):
        for i, t in zip(cols["doc_id"], cols["text"], strict=True):
            yield i, [{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in spans(t, told.value)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), _SCHEMA, rows)


def redacted(text: str | None, known: dict[str, int] | None = None, mark: str = "[SECRET]") -> str | None:
    """``text`` with each secret's characters replaced by ``mark``; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s, _, e, _ in spans(text, known):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced, and ``n_chars``, if there is such a column, counted anew where it changed.

    Null texts and clean rows stay as they are; repeated rows are changed alike; an empty table stays empty; columns
    of any name pass through.
    """
    arrow_batches(docs.sparkSession)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    told = docs.sparkSession.sparkContext.broadcast(ranks(vocabularies, corpus_words(docs)))

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redacted(t, told.value) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.column(at).type)
            if count is not None:
                n = b.column(count).to_pylist()
                cols[count] = pa.array([len(t) if t != o else c for t, o, c in zip(new, old, n, strict=True)], b.column(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, base digest and span list of ``scan``'s rows."""
    f = F.col("found")

    def joined(x):
        return F.array_join(F.transform(x, lambda y: F.concat_ws(":", y["kind"], y["start"].cast("string"), y["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(f, lambda x: x["kind"] != "guess")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(f).alias("spans"), n("guess"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
