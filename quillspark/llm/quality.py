"""Quality rules as a bitmask ledger.

Every rule is evaluated once: a pass over the texts stores measurements and, for each rule that a text fails, a bit.
Policies are versioned sets of rules, applied to the stored bits; what a rule adds to a policy (its ablation) is told by
bitwise aggregation over the ledger. No text is read again for either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from quillspark.llm.common import arrow_batches

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Whole numbers that a pass over a text measures.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_list_lines", "n_cut_lines")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger, and the SQL condition over measurements that sets it. Bits are never used anew: a rule that changes gets another."""

    bit: int
    name: str
    fails: str


#: Published thresholds of web-text filters, in whole numbers.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "wordless", "10 * n_letter_words < 7 * n_words"),
    Rule(5, "short_words", "word_chars < 3 * n_words"),
    Rule(6, "long_words", "word_chars > 12 * n_words"),
    Rule(7, "list", "n_lines >= 10 and 10 * n_list_lines > 9 * n_lines"),
    Rule(8, "cut_lines", "n_lines >= 10 and 10 * n_cut_lines > 3 * n_lines"),
    Rule(9, "many_words", "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    """A version of a choice of rules: a text that fails one of them goes."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[r] for r in self.rules)


#: The contract's own two rules, then what was added to them. ``many_words`` is in the ledger but in no policy: length alone is no fault.
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("web", 1, (*BASE.rules, "symbols", "repeated_lines")),
    Policy("web", 2, (*BASE.rules, "symbols", "repeated_lines", "wordless", "short_words", "long_words", "list", "cut_lines")),
)
CURRENT = POLICIES[-1]

_SPACE = b" \t\n\v\f\r"
_GAP = re.compile(rb"[ \t\n\v\f\r]")
_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_OTHERS = bytes(b for b in range(256) if b not in _LETTERS and b not in _SPACE)
_LIST = tuple(x.encode() for x in ("-", "*", "•"))
_CUT = tuple(x.encode() for x in ("...", "…"))


def _pieces(data: bytes):
    """``data`` in pieces that end where no word is."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that are found twice or more; ``ids`` are the words' numbers below ``distinct``."""
    if len(ids) < 4 or distinct == len(ids):
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    pair, base = a * distinct + b, distinct * distinct
    if base * distinct >= 2**63:  # number the pairs that are there
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * distinct + c
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    again = np.zeros(len(ids), bool)
    starts = order[same[1:] | same[:-1]]
    for k in range(3):
        again[starts + k] = True
    return int(again.sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of a whole text. Lines hold a word; letters are A-Z, a-z and all beyond ASCII; list lines begin with a dash, star or dot and cut lines end with an ellipsis."""
    data = text.encode()
    known: dict[bytes, int] = {}
    parts, letters = [], 0
    for piece in _pieces(data):
        words = piece.split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        letters += len(piece.translate(None, _OTHERS).split())
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    chars = len(text) - sum(data.count(bytes([c])) for c in _SPACE)
    seen, lines, listed, torn = set(), 0, 0, 0
    for line in data.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            seen.add(line)
            listed += bare.startswith(_LIST)
            torn += bare.endswith(_CUT)
    symbols = sum(data.count(bytes([c])) for c in b"#*$%&|<>")
    return len(ids), chars, symbols, lines - len(seen), repeated_words(ids, len(known)), lines, letters, listed, torn


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as doc_id, MEASURES (long) and ``failed`` (long), the bits of the rules that a row's text fails.

    One pass, no shuffle. A null text has no words, as an empty one; repeated rows and null ids have a row each; an empty table gives
    an empty ledger. A very long text is cut into words in pieces: its task holds it, its lines, its distinct words and eight bytes a word.
    Other columns are ignored.
    """
    if len({r.bit for r in rules}) < len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("rules need bits of their own, from 0 to 62")
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([to_arrow_schema(rows.schema).field(0), *[pa.field(m, pa.int64()) for m in MEASURES]])

    def run(batches):
        for b in batches:
            got = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(b.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in got.T]], names=schema.names)

    measured = rows.mapInArrow(run, from_arrow_schema(schema))
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def verdicts(stored: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept``: whether a row fails none of the policy's rules. Only bits are read."""
    return stored.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablations(stored: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, version, rule, in_policy, n_rows, n_kept, n_failed, n_alone, n_other: for each policy and rule, rows that the policy keeps, that fail the rule,
    that go for this rule alone (they would stay without it) and that it would add to what goes (rules outside the policy).

    The ledger is reduced to its distinct bit patterns with counts first, combined in each task; there are as many
    patterns as occur, whatever the rows. An empty ledger gives an empty result.
    """
    whole = lambda n: F.lit(n).cast("long")
    ask = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), whole(p.mask(rules)).alias("mask"), F.lit(r.name).alias("rule"), whole(1 << r.bit).alias("bit")) for p in policies for r in rules]
    x = stored.groupBy("failed").agg(F.count("*").alias("n")).select("failed", "n", F.inline(F.array(*ask)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit, own = F.col("failed").bitwiseAND(F.col("mask")), F.col("failed").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("policy", "version", "rule", (F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("in_policy")).agg(
        F.sum("n").alias("n_rows"),
        total(hit == 0).alias("n_kept"),
        total(own).alias("n_failed"),
        total(own & (hit == F.col("bit"))).alias("n_alone"),
        total(own & (hit == 0)).alias("n_other"),
    )


def coverage(stored: DataFrame, *by: str) -> DataFrame:
    """For each group of the ledger's rows, the bits that any row fails (``any_failed``), that all fail (``all_failed``) and that an odd number fails (``parity``)."""
    return stored.groupBy(*by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.bit_xor("failed").alias("parity"), F.count("*").alias("n_rows"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` by the current policy."""
    led = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), CURRENT)
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask()).cast("long")) != 0
    return led.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", *MEASURES[5:], "failed")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT * FROM (SELECT k, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE c IS NOT NULL),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
ln AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
li AS (
  SELECT k, count(*) AS n, count(DISTINCT l) AS u, count(*) FILTER (WHERE regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) AS listed,
         count(*) FILTER (WHERE regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS torn
  FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(li.n - li.u, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(li.n, 0) AS n_lines,
         CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS BIGINT) AS n_letter_words,
         coalesce(li.listed, 0) AS n_list_lines, coalesce(li.torn, 0) AS n_cut_lines
  FROM d JOIN w ON d.k = w.k LEFT JOIN li ON d.k = li.k LEFT JOIN rep ON d.k = rep.k),
f AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 2 * n_repeat_words > n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN 10 * n_letter_words < 7 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 32 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_lines >= 10 AND 10 * n_list_lines > 9 * n_lines THEN 128 ELSE 0 END
    + CASE WHEN n_lines >= 10 AND 10 * n_cut_lines > 3 * n_lines THEN 256 ELSE 0 END + CASE WHEN n_words > 100000 THEN 512 ELSE 0 END AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 511 = 0 AS kept,
       n_lines, n_letter_words, n_list_lines, n_cut_lines, failed
FROM f"""
