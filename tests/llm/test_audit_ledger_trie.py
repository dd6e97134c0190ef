"""Divergence audit, quality ledger and prefix trie against brute force and SQL, on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, quality, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("term", "n", "total", "docs", "p", "q", "p0", "v", "size", "support", "item", "value", "rank", "part", "failed", "kept", "n_words", "n_lines", "label", "path", "ids", "words", "first", "ends", "key", "h", "of", "depth", "parent", "split")


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_sql(sql, columns, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.sql(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


DUCK_DOCS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"


# --- 11 divergence


def audited(docs, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in docs]
    inside = defaultdict(Counter)
    for lang, _, ts in docs:
        inside[lang].update(set(ts))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in inside.items()}
    count = defaultdict(Counter)
    for lang, source, ts in docs:
        count[lang, source].update(t for t in ts if t in set(kept[lang]))
        count[lang, None].update(t for t in ts if t in set(kept[lang]))
    price = lambda g, t: 1 + 1000000000 * (count[g][t] + 1) // (sum(count[g].values()) + len(kept[g[0]]))
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for g in groups:
        pairs = [(h[1], sum(f(price(g, t), price(h, t)) for t in kept[g[0]])) for h in groups if h[0] == g[0] and h != g]
        own = [(t, f(price(g, t), price((g[0], None), t))) for t in kept[g[0]] if count[g][t] and price(g, t) > price((g[0], None), t)]
        for part, items in (("pair", pairs), ("term", own)):
            for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))):
                if part == "pair" or k < top:
                    out.append((g[0], g[1], part, item, value, k + 1))
    return sorted(out, key=str)


def random_documents(seed, n=60):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "ß", "été", "ÉTÉ", "x1y", "a_b", "漢字", "don't", "zz", "q"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "s3", None, "ü"]), 0) for i in range(n)]
    return [*docs, docs[3], docs[3], (None, None, None, None, None), (99, None, "de", "alone", 0), (98, "", "en", "empty", 0), (97, "solo words only here", "it", "b", 0), (96, "1 2 3", "it", "a", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_brute_force_and_sql(spark, seed):
    docs = random_documents(seed)
    got = rows_of(divergence.audit(clashing(spark.createDataFrame(docs, DOCS))))
    assert got == audited(docs)
    assert got == by_sql(divergence.SQL, ("lang", "source", "part", "item", "value", "rank"), documents=(DUCK_DOCS, docs))
    assert any(r[2] == "pair" and r[4] > 0 for r in got) and any(r[2] == "term" for r in got)


def test_divergence_reports_the_first_terms_only_and_no_table(spark):
    docs = random_documents(3, 200)
    assert rows_of(divergence.audit(spark.createDataFrame(docs, DOCS), least=1, top=2)) == audited(docs, 1, 2)
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_terms_of_a_long_text_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(4).choice(["Ab", "ça", "x-y", "0"]) for _ in range(5000)) + "z" * 5000
    whole = list(divergence.terms(text))
    monkeypatch.setattr(divergence, "PIECE", 100)
    parts = list(divergence.terms(text))
    assert len(whole) == 1 and len(parts) > 50 and [w for p in parts for w in p] == whole[0]


def test_divergence_sends_partial_sums(spark, monkeypatch):
    docs = random_documents(5)
    monkeypatch.setattr(divergence, "ENTRIES", 2)
    assert sum(1 for _ in divergence._partial(iter(spark.createDataFrame(docs, DOCS).selectExpr("coalesce(lang, '')", "coalesce(source, '')", "coalesce(text, '')").toArrow().to_batches(16)))) > 2


# --- 12 quality


def measured(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    letters = [w for w in words if re.search(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", w)]
    bare = [x.strip(" \t\n\v\f\r") for x in lines]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines), len(letters), sum(x[0] in "-*•" for x in bare), sum(x.endswith(("...", "…")) for x in bare))


def odd_texts():
    r = random.Random(7)
    words = ["a", "b", "ab", "é", "漢", "#", "- x", "12", "...", "…\n", "\n", "\r\n", "\t", "\x0b", "\xa0", "\x1c", "•", "|"]
    return ["", None, " \n\t", "a b c a b c", "a a a a", "x " * 60, *["".join(r.choice([*words, " ", " "]) + r.choice(["", " "]) for _ in range(r.randint(1, 150))) for _ in range(300)]]


def test_measures_equal_brute_force(monkeypatch):
    for t in odd_texts():
        assert quality.measure(t or "") == measured(t), t
    monkeypatch.setattr(quality, "PIECE", 7)
    for t in odd_texts():
        assert quality.measure(t or "") == measured(t), t


def test_repeated_words_of_very_many_distinct_words():
    ids = np.array([1, 5, 9, 2, 1, 5, 9, 1, 5, 8])
    assert quality.repeated_words(ids, 11) == quality.repeated_words(ids, 1 << 22) == 6


def test_quality_ledger_policies_and_ablations(spark):
    docs = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate([*odd_texts(), "word " * 3 + " ".join(f"w{i}" for i in range(60)), " ".join(f"{i}" for i in range(60)), "\n".join(f"- item number {i}" for i in range(40)), "\n".join(f"goes on {i}..." for i in range(40)), "one line\n" * 50, " ".join(f"{chr(97 + i % 26)}{i // 26}" for i in range(60)), " ".join(f"donaudampfschiff{i}" for i in range(60))])]
    docs += [docs[5], (None, "no id", None, None, None)]
    led = quality.ledger(clashing(spark.createDataFrame(docs, DOCS))).persist()
    names = ("doc_id", *quality.MEASURES)
    assert rows_of(led.select(*names)) == sorted(((i, *measured(t)) for i, t, *_ in docs), key=str)

    def fails(t, rule):
        return bool(eval(rule.fails, dict(zip(quality.MEASURES, measured(t), strict=True))))

    bits = [sum(1 << r.bit for r in quality.RULES if fails(t, r)) for _, t, *_ in docs]
    assert sorted(r["failed"] for r in led.collect()) == sorted(bits)
    rare = [r for r in quality.RULES if r.name != "many_words"]
    assert all(any(b >> r.bit & 1 for b in bits) for r in rare)
    for p in quality.POLICIES:
        mask = p.mask()
        assert quality.verdicts(led, p).filter("kept").count() == sum(not b & mask for b in bits)
    told = {(r["policy"], r["version"], r["rule"]): r for r in quality.ablations(led).collect()}
    assert len(told) == len(quality.POLICIES) * len(quality.RULES)
    for p in quality.POLICIES:
        for r in quality.RULES:
            x, mask, bit = told[p.name, p.version, r.name], p.mask(), 1 << r.bit
            want = (r.name in p.rules, len(bits), sum(not b & mask for b in bits), sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(bool(b & bit) and not b & mask for b in bits))
            assert tuple(x[c] for c in ("in_policy", "n_rows", "n_kept", "n_failed", "n_alone", "n_other")) == want
    one = quality.coverage(led).collect()[0]
    assert (one["any_failed"], one["all_failed"], one["parity"]) == (int(np.bitwise_or.reduce(bits)), int(np.bitwise_and.reduce(bits)), int(np.bitwise_xor.reduce(bits)))
    got = by_sql(quality.SQL, ("doc_id", "n_words", "failed"), documents=(DUCK_DOCS, docs))
    assert got == rows_of(led.select("doc_id", "n_words", "failed"))
    led.unpersist()


def test_quality_rules_and_empty_tables(spark):
    empty = quality.ledger(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and quality.ablations(empty).collect() == []
    with pytest.raises(ValueError):
        quality.ledger(spark.createDataFrame([], DOCS), rules=(quality.Rule(1, "a", "true"), quality.Rule(1, "b", "true")))
    with pytest.raises(KeyError):
        quality.Policy("x", 1, ("unknown",)).mask()


def test_quality_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    led = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    x = quality.verdicts(led, quality.CURRENT).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("failed & 3 = 0")
    n = {(r["quality"], r["kept"]): r["count"] for r in x.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * n[0, False]  # clean documents stay, junk goes


# --- 13 trie

TURNS = "conv_id long, turn long, role string, text string"
DUCK_TURNS = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"


def grown(turns):
    """The nodes, from dictionaries of all prefixes."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for s, cs in members.items():
        below = [t for t in members if t[: len(s)] == s]
        leaves = sum(1 for t in below if not any(len(u) > len(t) and u[: len(t)] == t for u in members))
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t[-1][1])) if t else 0
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(s))
        kids = sum(1 for t in below if len(t) == len(s) + 1)
        out.append((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), kids, leaves, sum((len(members[t]) - 1) * words(t) for t in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_turns(seed, n=70):
    r = random.Random(seed)
    texts = ["hi there", "", None, "a b c", "how are you", "é ü"]
    turns = []
    for c in [*r.sample(range(300), n), -5, -20, 2**40]:
        turns += [(c, t if r.random() < 0.95 else None, r.choice(["user", "user", "assistant", None]), r.choice(texts[: 2 + c % 5])) for t in range(r.choice([1, 2, 2, 3, 5, 9]))]
    return [*turns, turns[0], turns[0], (None, 1, "user", "nobody's"), (401, 0, None, None)]


@pytest.mark.parametrize("local", [0, 6, 10**6])
def test_trie_equals_brute_force_and_sql(spark, local):
    turns = random_turns(local)
    got = rows_of(trie.prefix_trie(clashing(spark.createDataFrame(turns, TURNS)), local=local))
    assert got == grown(turns)
    assert got == by_sql(trie.SQL, trie._COLUMNS, conversations=(DUCK_TURNS, turns))


def test_trie_of_long_shared_chains_and_copies(spark):
    chain = [("user", f"turn {i}") for i in range(300)]
    turns = [(c, i, *x) for c in range(0, 240, 20) for i, x in enumerate(chain[: 300 - (c // 20) % 3])]
    turns += [(c, 0, "user", "same") for c in range(1000, 1900, 20)] + [(7, 0, "user", "other"), (7, 1, "user", "way")]
    want = grown(turns)
    for local in (50, 10**6):
        assert rows_of(trie.prefix_trie(spark.createDataFrame(turns, TURNS), local=local)) == want


def test_trie_lists_many_copies_in_pieces(spark, monkeypatch):
    turns = [(c, 0, "user", "same") for c in range(0, 4000, 20)]
    by_key = spark.createDataFrame([("k", c) for c, *_ in turns] + [("l", 1)], "key string, conv_id long").coalesce(1).sortWithinPartitions("key", "conv_id").toArrow().to_batches(32)
    monkeypatch.setattr(trie, "PIECE", 50)
    pieces = [x for b in trie._lists(iter(by_key)) for x in b.to_pylist()]
    assert len(pieces) > 10 and ",".join(x["list"] for x in pieces if x["key"] == "k") == ",".join(str(c) for c, *_ in turns)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(turns, TURNS))) == grown(turns)


def test_trie_beyond_the_broadcast_bound_and_of_no_turns(spark, monkeypatch):
    turns = random_turns(11)
    monkeypatch.setattr(trie, "TOLD", 0)
    assert rows_of(trie.prefix_trie(spark.createDataFrame(turns, TURNS), local=4)) == grown(turns)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_audit_ledger_and_trie_queries_against_sql(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for query, sql in ((divergence.op11_divergence, divergence.SQL), (quality.op12_quality, quality.SQL), (trie.op13_trie, trie.SQL)):
        got = query(spark, sf)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == sorted(want.select(*got.columns).fetchall(), key=str)
