"""The corpus operators against brute force, exact cases and held-out accuracy, on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import boosting, bwt, components, decontamination, html, language, mixing, pii, secrets, simhash, substrings, topk, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents of (id, text) rows, with columns whose names operators might use inside."""
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for c in ("fp", "h", "root", "chunk", "key", "_text", "found", "size", "range", "label", "score", "bucket", "_id", "_h", "_n", "n", "a", "b", "hits", "items", "part", "copy", "c", "i", "t"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def filler(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words))


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here"), (None, None), (4, "same text twice"), (4, "same text twice"), (5, "é" * 3000 + " ß 漢字"), (6, filler(1, 30_000))]


# --- 1 secrets


def base_spans(t):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_base_spans_equal_brute_force(spark):
    texts = [(i, t) for i, t in enumerate(["password = 'abcdefghijkl' x", "API_KEY:abc.def-ghi_jkl=", "AKIA" + "A" * 13, "AKIA" + "B" * 14 + "c", "deadbeef" * 3, "ſecret=aaaaaaaaaaaaaa", "token token: 0123456789abcdef0", "é" * 5 + "passwd=" + "Z" * 12])]
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.scan(documents(spark, texts))).collect()}
    for i, t in texts:
        want = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(t))
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert rows[4]["n_hex"] == 1 and rows[3]["n_access"] == 1 and rows[2]["n_access"] == 0


def test_guess_costs():
    cheap = ["password2024", "qwertyuiop", "P@ssw0rd!", "aaaaaaaaaaaa", "12/05/1999", "abcabcabcabc", "changeme", "your-api-key-here"]
    assert all(secrets.guess_cost(v) < secrets.COST for v in cheap)
    assert all(secrets.guess_cost(v) >= secrets.COST for v in ["x9$kLq2!vRz8", "tK3#pW8^mQ1z"])
    # never more than brute force, and no dearer for a repeat than for its parts
    assert secrets.guess_cost("xkxkxkxk") < secrets.guess_cost("xkqzvbjw")
    assert [x[1] for x in secrets.spans("pwd: x9$kLq2!vRz8 and pwd: qwertyuiop")] == [3]


def cheapest(v, known):
    """The least cost over all segmentations, tried one by one."""
    import functools
    import math

    single = {}
    ending = secrets._segments(v, known)
    for e in range(1, len(v) + 1):
        for m, c in ending(e):
            single[e - m, e] = min(c, single.get((e - m, e), math.inf))

    @functools.cache
    def best(s):
        if s == len(v):
            return 0.0
        out = secrets._brute(v[s]) + best(s + 1)
        for e in range(s + 1, len(v) + 1):
            if (s, e) in single:
                out = min(out, 0.3 + single[s, e] + best(e))
            for m in range(1, (e - s) // 2 + 1):
                if v[s : s + m] * ((e - s) // m) == v[s:e] and (e - s) % m == 0:
                    once = min(sum(map(secrets._brute, v[s : s + m])), single.get((e - m, e), math.inf))
                    out = min(out, 0.3 + once + math.log10((e - s) // m) + best(e))
        return out

    return best(0)


def test_guess_cost_is_that_of_the_best_segmentation():
    r = random.Random(1)
    known = {w: k + 1 for k, w in enumerate(secrets.WORDS)}
    pieces = ["password", "qwe", "1999", "abc", "aa", "ababab", "7654", "x", "9", "$", "pass", "s", "s", "P@ss", "12/05/1999"]
    for _ in range(400):
        v = "".join(r.choice(pieces) for _ in range(r.randint(1, 6)))
        assert secrets.guess_cost(v, known) == pytest.approx(cheapest(v, known))


def test_ordinary_words_are_no_secrets_and_long_texts_end():
    for v in ("production", "postgresql", "mississippi", "jennifer1985", "staging-server"):
        assert secrets.guess_cost(v) < secrets.COST
    noise = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz0123456789$%&!", k=200_000))
    assert secrets.guess_cost(noise, enough=secrets.ENOUGH) == secrets.ENOUGH
    many = " ".join(f"token=abcdefghijkl{i}" for i in range(20_000)) + " pwd: x9$kLq2!vRz8"
    got = secrets.spans(many)
    assert len(got) == 20_001 and got[-1][1] == 3
    assert secrets.ranks(()).keys() == set(secrets.WORDS) and list(secrets.ranks((), ["zebra", "admin"]))[-1] == "zebra"
    with pytest.raises(FileNotFoundError):  # not another result on another machine
        secrets.ranks(("/no/such/file",))


GERMAN = ("donaudampfschiff", "Bundesrepublik", "Geschwindigkeit", "Krankenhaus", "Zusammenarbeit")


def planted_values(seed, n):
    """Credentials and what only looks like one, by rules, in a credential's context."""
    r = random.Random(seed)
    words = [w for w in secrets.ranks() if 4 <= len(w) <= 9][:8000]
    low = "abcdefghijklmnopqrstuvwxyz"
    many = low + low.upper() + "0123456789"
    some = lambda of, k: "".join(r.choice(of) for _ in range(k))
    w = lambda: r.choice(words)
    real = [
        lambda: some(many, r.randint(12, 24)), lambda: some(many + "!#$%&*+?@^~", r.randint(10, 16)), lambda: some(low + "234567", 16), lambda: "-".join(some(many, 5) for _ in range(4)),
        lambda: "ghp_" + some(many, 20), lambda: f"eyJ{some(many, 12)}.{some(many, 14)}.{some(many, 10)}",
    ]
    other = [
        lambda: f"{w()}{r.randint(1950, 2030)}", lambda: w().capitalize() + r.choice("!1.") + r.choice(["", "123"]), lambda: r.choice(["qwertyuiop", "asdfghjkl1", "1234567890", "abcdefgh", "zxcvbnm123", "aaaaaaaaaa", "abcabcabcabc"]),
        lambda: f"os.environ['{w().upper()}']", lambda: f"process.env.{w().upper()}_{w().upper()}", lambda: f"/{w()}/{w()}/{w()}", lambda: f"${{{w()}}}", lambda: f"get_{w()}({w()})", lambda: w() + r.choice("_-") + w(),
        lambda: f"localhost:{r.randint(1000, 9999)}/{w()}", lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1950, 2020)}", lambda: f"{w()}.{r.choice(['yml', 'json', 'txt', 'pem'])}", lambda: f"your-{w()}-here", lambda: w() + w(),
        lambda: r.choice(GERMAN),
    ]
    context = ["password: {}", "pwd = {} ", "the token is {} now", "auth: {}", "'api_key' : '{}'", "bearer: {}"]
    return [(r.choice(context).format(r.choice(of)()), of is real) for _ in range(n) for of in (real, other)]


def test_guesses_of_planted_values():
    """The bar was set on seed 1; seed 2 was read once: recall and precision 1.00 with the words of the language counted, precision 0.96 without."""
    known = secrets.ranks(secrets.VOCABULARIES, [w.lower() for w in GERMAN])
    got = [(bool(secrets.spans(t, known)) if real else any(k == 3 for _, k, _, _ in secrets.spans(t, known)), real) for t, real in planted_values(2, 600)]
    right, wrong = sum(g and y for g, y in got), sum(g and not y for g, y in got)
    assert right >= 0.99 * 600 and right / (right + wrong) >= 0.97


def test_words_of_the_texts_are_no_secrets(spark):
    texts = [(i, f"Die (Geschwindigkeit) der Bundesrepublik, x9kLqvRzTT{i} ist hoch!") for i in range(6)] + [(9, "password is Bundesrepublik, or x9kLqvRzTTqM1"), (10, None)]
    d = documents(spark, texts)
    words = secrets.corpus_words(d)
    assert {"geschwindigkeit", "bundesrepublik", "ist", "hoch"} <= set(words) and not any("lqv" in w for w in words)
    assert secrets.corpus_words(d, most=2) == words[:1] == ["bundesrepublik"] and secrets.corpus_words(d.filter("false")) == []
    got = {r["doc_id"]: [(f["kind"], f["start"]) for f in r["found"]] for r in secrets.scan(d).collect()}
    assert got[9] == [] and got[0] == []
    assert [k for _, k, _, _ in secrets.spans("password is Bundesrepublik", secrets.ranks())] == [3]  # but for the count of its words


def test_secrets_redaction_and_odd_rows(spark):
    d = documents(spark, [*ODD, (7, "a token=abcdefghijkl123 b deadbeefdeadbeef")])
    rows = {(r["doc_id"], r["text"]): r for r in secrets.redact(d).collect()}
    assert any(k[1] == "a [SECRET] b [SECRET]" and r["n_chars"] == len(k[1]) for k, r in rows.items())
    assert secrets.scan(d).count() == len(ODD) + 1 and secrets.scan(d.filter("false")).count() == 0
    assert secrets.redact(d.filter("false")).count() == 0 and secrets.redact(d.drop("n_chars")).count() == len(ODD) + 1
    twice = [r["found"] for r in secrets.scan(d.union(d)).filter("doc_id = 7").collect()]
    assert len(twice) == 2 and twice[0] == twice[1] and len(twice[0]) == 2


# --- 2 decontamination


def brute_hits(w, windows):
    hit, items = set(), set()
    for item, p in windows:
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                hit.update(range(i, i + len(p)))
                items.add(item)
    return hit, items


def test_wu_manber_equals_brute_force():
    r = random.Random(5)
    vocabulary = ["a", "b", "c", "dd", "ee"]
    items = [(str(i), " ".join(r.choice(vocabulary) for _ in range(r.choice((1, 2, 3, 4, 12, 13, 20))))) for i in range(25)]
    windows = [(i, decontamination.words(t)[k : k + 13]) for i, t in items for k in range(max(1, len(decontamination.words(t)) - 12))]
    m = decontamination.WuManber(items)
    for _ in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        hits, found = m.search(w)
        want, ids = brute_hits(w, windows)
        assert {j for s, e in decontamination.union(hits) for j in range(s, e)} == want and found == ids


def test_decontamination_passes_agree(spark):
    text = filler(8, 60)
    b = spark.createDataFrame([(1, text), (2, "Only Three words"), (None, "zz"), (3, None), (4, "...")], "item_id long, text string")
    d = documents(spark, [*ODD, (8, "x " + text.upper() + " y"), (9, filler(9, 500) + " only three WORDS"), (10, "zz")])
    one = decontamination.judge(decontamination.find(d, b))
    many = decontamination.judge(decontamination.find(d, b, pass_bytes=100))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)
    got = {r["doc_id"]: r for r in one.collect()}
    assert got[8]["contaminated"] and got[8]["n_hit"] == 60 and not got[9]["contaminated"] and got[9]["n_hit"] == 3 and got[10]["contaminated"]
    for limit in (decontamination.PASS_BYTES, 100):
        assert sorted(r["doc_id"] or 0 for r in decontamination.clean(d, b, limit).collect()) == [0, 0, 1, 2, 3, 4, 4, 5, 6, 9]
    assert decontamination.find(d, b.filter("false")).filter("size(hits) > 0").count() == 0


# --- 3 PII

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(d))) % 10 == 0


def pii_base(t):
    def ok(k, v):
        d = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        return k == "email" or (12 <= len(d) <= 19 and luhn(d) if k == "card" else 9 <= len(d) <= 15)

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, t) if ok(k, m[0]))


def test_pii_equals_brute_force(spark):
    r = random.Random(2)
    pieces = ["a@b.c", "a.b@c-d.e.f", "@d.e", "a@b..c", "x_y%z@q.r.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-5555", "+", "7", " ", "--", ".", "é", "\x01", "\x02", "378282246310005", "007.8.9.1"]
    texts = [(i, "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))) for i in range(300)] + [(900, "1-" * 40_000), (901, "a." * 40_000 + "@"), (902, "a@" + "b." * 30_000 + "c"), (903, "9" * 50_000)]
    got = {x["doc_id"]: x for x in pii.digest(pii.detect(documents(spark, texts))).collect()}
    for i, t in texts:
        if i == 901:
            assert got[i]["spans"] == ""
            continue
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii_base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t[:100]


def test_pii_iban_context_and_odd_rows(spark):
    d = documents(spark, [*ODD, (20, "Konto GB82 WEST 1234 5698 7654 32 ok"), (21, "GB82 WEST 1234 5698 7654 33"), (22, "call +1 555 555 5555"), (23, "x +1 555 555 5555")])
    got = {x["doc_id"]: x for x in pii.digest(pii.detect(d)).collect()}
    assert got[20]["n_iban"] == 1 and got[21]["n_iban"] == 0
    assert int(got[22]["scores"]) > int(got[23]["scores"])
    assert not any(isinstance(f.dataType, T.NullType) for f in pii.detect(d).schema) and pii.detect(d.filter("false")).count() == 0


# --- 4 HTML


def test_html_extraction(spark):
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div><article><h1>T &amp; x</h1><p>One   two&nbsp;three.<p><b>Four.<br><p>B. <script>var a='</p>';</script></article><section id=comments><p>Nice post.</p></section><footer>c</footer></body></html>"
    p = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "plain"), (None, "u", "<p>x"), (6, "u", "<div>" * 5000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.main_text(p).collect()}
    assert got[1]["text"] == "T & x\nOne two three.\nFour.\nB."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain"


def test_html_holds_on_unseen_generated_pages():
    model, r, same = html.fitted(), random.Random(12345), 0
    for _ in range(150):
        page = html.training_page(r)
        clean = re.sub(r"<!--(?:on|off)-->", "", page)
        _, state = html._truth(page)
        _, blocks = html.parse(clean)
        same += html.extract([clean], model)[0] == "\n".join(t for x, t in blocks if state[x.at] == html.IN)
    assert same >= 140


HANDWRITTEN = [
    # a blog post under a wrapper, with a share bar in it and comments after it
    (
        """<!doctype html><html><head><title>My blog | A walk</title><style>p{}</style></head><body class="home"><header class="site-header"><a href="/">My blog</a></header>
        <div id="wrapper"><div class="post"><h2>A walk in the hills</h2><p>We left at dawn, when the fog still lay on the fields.</p><p>By noon the path had gone, and so had our bread.</p>
        <div class="share-buttons"><a href="#">Tweet</a> <a href="#">Pin</a></div><p>It was dark when we came home.</p></div><div id="comments"><h3>2 comments</h3><p>Lovely pictures!</p><p>Where was this?</p></div></div>
        <footer><p>All rights reserved.</p></footer></body></html>""",
        "A walk in the hills\nWe left at dawn, when the fog still lay on the fields.\nBy noon the path had gone, and so had our bread.\nIt was dark when we came home.",
    ),
    # an article whose class speaks against it, and a notice before it
    (
        '<body><div class="cookie-banner"><p>We value your privacy.</p><button>Accept</button></div><article class="post comment-policy"><h1>Our rules for comments</h1><p>Be kind. Stay on the subject.</p><p>We read each of them, but not at night.</p></article></body>',
        "Our rules for comments\nBe kind. Stay on the subject.\nWe read each of them, but not at night.",
    ),
    # a main element with an unlucky inner class, lists and a table
    (
        "<nav><a href=/a>A</a><a href=/b>B</a></nav><main><h1>Bread</h1><div class='more-text'><p>Flour, water, salt, and time.</p></div><ul><li>500 g flour<li>350 g water</ul><table><tr><td>Rise</td><td>3 h</td></tr></table></main><aside><p>Read also: soups.</p></aside>",
        "Bread\nFlour, water, salt, and time.\n500 g flour\n350 g water\nRise\n3 h",
    ),
    # formulas, words without scripts and an object's own words belong to the article; scripts and forms do not
    (
        "<article><p>The formula <math><mi>x</mi> = <mn>2</mn></math> holds.</p><noscript><p>The chart shows a rise.</p></noscript><object data='a.swf'>A film of it.</object><script>alert('<p>no</p>')</script><form><p>Your name</p><input></form></article>",
        "The formula x = 2 holds.\nThe chart shows a rise.\nA film of it.",
    ),
    # references, odd white space, unclosed paragraphs
    ("<main><p>Caf&eacute; &amp; bar\n\t open&#58;&nbsp; daily<p>Closed&hellip; never.</main>", "Caf\u00e9 & bar open: daily\nClosed\u2026 never."),
]


@pytest.mark.parametrize("case", range(len(HANDWRITTEN)))
def test_html_on_handwritten_pages(case):
    page, want = HANDWRITTEN[case]
    assert html.extract([page], html.fitted()) == [want]


def test_html_odd_rows(spark):
    p = spark.createDataFrame([(1, "u", "<article><p>Twice told tale.</p></article>"), (1, "u", "<article><p>Twice told tale.</p></article>"), (2, None, "<main>" + "<p>Long page here.</p>" * 20_000 + "</main>"), (3, "u", None)], "page_id long, url string, html string")
    for c in ("text", "n_chars", "_id", "h"):
        p = p.withColumn(c, F.lit("clash"))
    got = html.main_text(p).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 16), (1, 16), (2, 15 * 20_000 + 19_999), (3, 0)]
    assert html.main_text(p.filter("false")).count() == 0


def test_fitted_trees_are_those_of_training():
    a, b = html.train(), html.fitted()
    assert (a.feature == b.feature).all() and (a.bound == b.bound).all() and np.allclose(a.value, b.value)


def test_training_does_not_hang_on_last_bits_of_numpys_exp(monkeypatch):
    a = html.train(150)
    exp, rng = np.exp, np.random.default_rng(5)
    monkeypatch.setattr(np, "exp", lambda x: exp(x) * (1 + rng.integers(-1, 2, np.shape(x)) * 2.0**-52))
    b = html.train(150)
    assert (a.feature == b.feature).all() and (a.bound == b.bound).all() and (a.value == b.value).all()


def test_decoding_never_contradicts():
    r = random.Random(4)
    for _ in range(50):
        nodes, _ = html.parse(html.training_page(r))
        state = html.decode(nodes, np.log(np.random.default_rng(1).dirichlet([1, 1, 1], len(nodes))))
        for x in nodes:
            if x.parent is not None:
                assert not (state[x.parent.at] == html.OUT and state[x.at] != html.OUT)
                assert not (state[x.parent.at] == html.IN and state[x.at] == html.ABOVE)


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = boosting.Boosted(2, rounds=20, depth=3).fit(x[:1500], y[:1500])
    assert (m.log_proba(x[1500:]).argmax(1) == y[1500:]).mean() > 0.95


# --- 5 SimHash


def brute_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in [None, "", " ", "One", "a b", "a b c", "A b C d é\x0bf", filler(3, 200)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_vantage_point_links_find_every_pair():
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([centres, *[centres ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(30)]]))
    got = {tuple(sorted(p)) for p in ((i, j) for part in simhash.links(x, 100) for i, j in zip(*map(np.ndarray.tolist, part)))}
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 2)) if i < j}
    assert got == {(int(i), int(j)) for i, j in want}
    tree, at = simhash.fit(x[::5], 16), np.arange(len(x))
    together = set()
    for _, p in simhash.shards(tree, x, at):
        s = set(p.tolist())
        together |= {(i, j) for i, j in got if i in s and j in s}
    assert together == got


def test_dense_shard_folds_its_pairs():
    """A ball of radius 2: 2,081 fingerprints with far more pairs than are ever held, and one class."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ball = np.unique(np.concatenate([[np.uint64(0)], one, (one[:, None] | one[None, :]).ravel()]))
    import pyarrow as pa

    got = simhash._solve(pa.table({"fp": ball.view(np.int64)}))
    assert got.num_rows == len(ball) - 1 and max(len(a) for a, _ in simhash.links(ball, 10_000)) < 300_000
    root = np.arange(len(ball))
    for a, b in simhash.links(ball, 10_000):
        root = simhash.classes(root, a, b)
    assert (root == 0).all()


def test_dense_part_is_spanned_by_neighbours(monkeypatch):
    """Balls within balls: what neighbours link are the classes of all pairs, whatever the parts."""
    rng = np.random.default_rng(9)
    low = rng.integers(0, 1 << 14, 3000, dtype=np.uint64)
    x = np.unique(np.concatenate([low, low[:100] | np.uint64(1 << 60), rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    a, b = np.nonzero((d <= 2) & (d > 0))
    want = simhash.classes(np.arange(len(x)), a, b)
    for most in (65 * len(x), 20_000):
        monkeypatch.setattr(simhash, "VARIANTS", most)
        root = np.arange(len(x))
        for a, b in simhash._variants(x):
            assert (np.bitwise_count(x[a] ^ x[b]) <= 2).all()
            root = simhash.classes(root, a, b)
        assert (root == want).all()
    monkeypatch.setattr(simhash, "DENSE", 16)
    monkeypatch.setattr(simhash, "DIRECT", 16)
    root = np.arange(len(x))
    for a, b in simhash.links(x, span=True):
        root = simhash.classes(root, a, b)
    assert (root == want).all()


def test_deduplicate_chooses_among_rows_of_one_id_and_text(spark):
    rows = [(1, "one text", "en", s, 8) for s in ("s2", "s1", None, "s1")] + [(2, "quite another one", "en", "s", 3)]
    for k in range(3):
        kept = simhash.deduplicate(spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(k + 1)).collect()
        assert sorted((r["doc_id"], r["source"]) for r in kept) == [(1, "s1"), (2, "s")]


def test_simhash_components_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in d.select("doc_id", "text").collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in rows:
        for j, y in rows:
            if i < j and bin(x ^ y).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.group(d).collect()}
    assert got == {i: (x, find(i)) for i, x in rows}


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(60)] + [(200 + i, 100) for i in range(1, 50)] + [(249, 248)]
    r = {x["node"]: x["root"] for x in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(r[i] == 0 for i in range(1, 61)) and all(r[200 + i] == 100 for i in range(1, 50))


def test_simhash_groups_and_keeps_one(spark):
    base = filler(7, 400)
    near = base.replace(base.split()[100], "changed", 1)
    d = documents(spark, [*ODD, (50, base), (51, base), (52, near), (53, filler(11, 400))])
    g = {}
    for r in simhash.group(d).collect():
        g.setdefault(r["doc_id"], r)
    assert g[51]["component_id"] == 50 and g[1]["component_id"] == g[2]["component_id"] == g[3]["component_id"] == 1
    assert (g[52]["component_id"] == 50) == (bin(simhash.fingerprint(base) ^ simhash.fingerprint(near)).count("1") <= 2)
    kept = simhash.deduplicate(d).collect()
    assert len([r for r in kept if r["doc_id"] == 4]) == 1 and {r["doc_id"] for r in kept} >= {1, 4, 5, 6, 50, 53} and not {2, 3, 51} & {r["doc_id"] for r in kept}
    assert len(kept) == len({r["root"] for r in simhash.group(d).collect()})
    assert simhash.group(d.filter("false")).count() == 0


# --- 6 substrings


def test_merged_transform_is_that_of_all_strings():
    r = random.Random(1)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(1, 12))).encode() for _ in range(40)]
    parts = [bwt.transform(strings[:13]), bwt.transform(strings[13:25]), bwt.transform(strings[25:])]
    z, place, interval = bwt.merge(parts, 64)
    assert len(set(interval.tolist())) == len(interval)  # by 64 symbols, end marks included, no two suffixes are alike
    merged = np.array([parts[k][1][p] for k, p in zip(z, place)])
    assert merged.tolist() == bwt.transform(strings)[1].tolist()


def test_repeated_windows_equal_brute_force():
    r = random.Random(2)
    pool = ["".join(r.choice("abc") for _ in range(30)) for _ in range(5)]
    strings = list({(r.choice(pool)[r.randint(0, 9) :] + r.choice(pool)[: r.randint(0, 25)]).encode() for _ in range(60)})
    docs = np.array([r.randint(1, 30) for _ in strings])
    got = bwt.least_by_window(strings, docs, [r.randint(0, 3) for _ in strings], 10)
    for s, g in zip(strings, got):
        assert g.tolist() == [min(int(d) for d, t in zip(docs, strings) if s[i : i + 10] in t) for i in range(len(s) - 9)]


def brute_removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [(substrings.HOT_HERE, substrings.HOT_ALL), (1, 2)])
def test_substrings_equal_brute_force(spark, hot):
    passage = filler(20, 40)
    rows = [(i, filler(100 + i, 30) + passage[i : 80 + 3 * i] + filler(200 + i, 30)) for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1].replace("a", "b", 1)), (22, "z" * 400), (23, "y" + "z" * 300), (24, None), (25, "short"), (26, "é" * 60), (27, "x" + "é" * 60)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(documents(spark, rows), 4, 4, *hot).collect()}
    assert got == brute_removed(rows)
    assert sum(v[1] for v in got.values()) > 500


def test_substrings_survive_lying_hashes(monkeypatch):
    """With 2 bits to tell copies within a chunk, nearly all hashes lie, and the bytes must find out; the rounds run here as they do in tasks."""
    import pyarrow as pa

    def grouped(tables, key):
        t = pa.concat_tables(tables)
        return {k: t.filter(pa.compute.equal(t.column(key), k)) for k in set(t.column(key).to_pylist())}

    def removed(rows, chunks=3, buckets=4, width=6):
        docs = pa.table({"doc_id": [i for i, _ in rows], "text": [(t or "").encode() for _, t in rows], "chunk": [i % chunks for i, _ in rows]})
        by_chunk = grouped([docs], "chunk")
        sent = grouped([substrings._introduce(width, buckets, 8)(t) for t in by_chunk.values()], "bucket")
        told = grouped([substrings._sort_out(width, buckets, 64)(t) for t in sent.values()], "chunk")
        none = substrings._table([], substrings._TOLD)
        strings = grouped([substrings._send_strings(width, 2)(t, told.get(k, none)) for k, t in by_chunk.items()], "bucket")
        compared = grouped([substrings._compare(t) for t in strings.values()], "chunk")
        out = [substrings._remove(width)(t, compared.get(k, none)) for k, t in by_chunk.items()]
        return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for t in out for r in t.to_pylist()}

    passage = filler(20, 40)
    rows = [(i, filler(100 + i, 20) + passage[i : 80 + 3 * i] + filler(200 + i, 20)) for i in range(14)]
    # one anchor in many contexts, so that differing segments of it meet in a chunk
    rows += [(30 + i, filler(300 + i, 8)[:13] + passage[40:64] + filler(400 + i, 8)[:13]) for i in range(30)] + [(90, rows[3][1]), (91, rows[3][1])]
    assert removed(rows) == brute_removed(rows)
    monkeypatch.setattr(substrings, "TOLD_BY", np.uint64(3))
    assert removed(rows) == brute_removed(rows)


def test_substrings_survive_lying_window_hashes(spark, monkeypatch):
    """Windows of hot anchors with 10 bits of hash: their bytes tell them apart."""
    honest = substrings.Runs.windows

    def lying(self, of):
        start, x = honest(self, of)
        return start, x & np.uint64(0x3FF)

    monkeypatch.setattr(substrings.Runs, "windows", lying)
    passage = filler(20, 60)
    rows = [(i, filler(100 + i, 20) + passage[i : 120 + 3 * i] + filler(200 + i, 20)) for i in range(24)]
    import pyarrow as pa

    for chunks in (1, 3):
        docs = pa.table({"doc_id": [i for i, _ in rows], "text": [t.encode() for _, t in rows], "chunk": [i % chunks for i, _ in rows]})
        parts = {k: docs.filter(pa.compute.equal(docs.column("chunk"), k)) for k in range(chunks)}

        def grouped(tables, key):
            t = pa.concat_tables(tables)
            return {k: t.filter(pa.compute.equal(t.column(key), k)) for k in set(t.column(key).to_pylist())}

        sent = grouped([substrings._introduce(6, 4, 1)(t) for t in parts.values()], "bucket")
        told = grouped([substrings._sort_out(6, 4, 2)(t) for t in sent.values()], "chunk")
        none = substrings._table([], substrings._TOLD)
        strings = grouped([substrings._send_strings(6, 2)(t, told.get(k, none)) for k, t in parts.items()], "bucket")
        compared = grouped([substrings._compare(t) for t in strings.values()], "chunk")
        out = [substrings._remove(6)(t, compared.get(k, none)) for k, t in parts.items()]
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for t in out for r in t.to_pylist()} == brute_removed(rows)


def _removed_in_rounds(rows, chunks=3, buckets=4, width=6, hot=(8, 64)):
    """What the rounds give that ``remove_repeats`` runs in tasks."""
    import pyarrow as pa

    def grouped(tables, key):
        t = pa.concat_tables(tables)
        return {k: t.filter(pa.compute.equal(t.column(key), k)) for k in set(t.column(key).to_pylist())}

    by_chunk = grouped([pa.table({"doc_id": [i for i, _ in rows], "text": [(t or "").encode() for _, t in rows], "chunk": [i % chunks for i, _ in rows]})], "chunk")
    sent = grouped([substrings._introduce(width, buckets, hot[0])(t) for t in by_chunk.values()], "bucket")
    told = grouped([substrings._sort_out(width, buckets, hot[1])(t) for t in sent.values()], "chunk")
    none = substrings._table([], substrings._TOLD)
    strings = grouped([substrings._send_strings(width, 2)(t, told.get(k, none)) for k, t in by_chunk.items()], "bucket")
    compared = grouped([substrings._compare(t) for t in strings.values()], "chunk")
    out = [substrings._remove(width)(t, compared.get(k, none)) for k, t in by_chunk.items()]
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for t in out for r in t.to_pylist()}


@pytest.mark.parametrize("bits", [64, 4])
def test_substrings_merge_only_what_may_be_repeated(monkeypatch, bits):
    """Anchors in 40 contexts that share no window cost no merge; a passage cut at both ends does. With 4 bits of hash all may be repeated, and nothing is wrong either."""
    merged, honest = [], substrings.Runs.hashes
    least = bwt.least_of_windows
    monkeypatch.setattr(substrings, "least_of_windows", lambda strings, *a: merged.extend(strings) or least(strings, *a), raising=False)
    monkeypatch.setattr(substrings.Runs, "hashes", staticmethod(lambda data, start: honest(data, start) & np.uint64(2**bits - 1)))
    anchor = filler(20, 40)[40:64]
    alone = [(100 + i, filler(300 + i, 8)[:25] + anchor + filler(400 + i, 8)[:25]) for i in range(40)]
    assert _removed_in_rounds(alone, hot=(64, 64)) == brute_removed(alone)
    assert bool(merged) == (bits == 4)
    passage = filler(30, 40)
    some = [(i, filler(100 + i, 8) + passage[3 * i : 120 + 3 * i] + filler(200 + i, 8)) for i in range(14)]
    assert _removed_in_rounds(alone + some, hot=(64, 64)) == brute_removed(alone + some)
    assert merged
    if bits == 64:
        assert all(s.decode() in passage for s in merged)


def test_segments_do_not_depend_on_blocks(monkeypatch):
    texts = [filler(i, 300).encode() for i in range(5)] + [b"short", b"z" * 500]
    got = []
    for block in (97, 1000, 1 << 16):
        monkeypatch.setattr(substrings, "BLOCK", block)
        r = substrings.Runs(texts)
        start, x = r.windows(np.arange(len(r.start)))
        got.append([a.tolist() for a in (r.start, r.length, r.doc, r.anchor, r.whole, start, x)])
    assert got[0] == got[1] == got[2]


def test_substrings_odd_rows(spark):
    rows = [*ODD, (None, filler(1, 30_000)), (7, "tail " + filler(1, 30_000))]
    got = substrings.remove_repeats(documents(spark, rows), 4, 4).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[7]["n_removed"] == by[7]["n_bytes"] - 5 and by[4]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    assert substrings.remove_repeats(documents(spark, ODD).filter("false"), 4, 4).count() == 0


# --- 7 language


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = language.predict(d, language.train(d), ("doc_id", "lang")).filter(~language.learning(d)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in p) / len(p) > 0.97 and all(0 <= r["score"] <= 1 for r in p)


def test_language_odd_rows(spark):
    d = documents(spark, [*ODD, (30, "12345 !! ½²")])
    m = language.train(d)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(d, m).collect()]
    assert {x for x in got if x[0] in (1, 2, 3, 30)} == {(i, "und", 0.0) for i in (1, 2, 3, 30)}
    assert language.train(d.filter("false")).predict("text") == ("und", 0.0)
    assert {r["doc_id"] for r in language.known(d, m).collect()} == {None, 4, 5, 6}


def test_language_learns_many_and_rare_ones(spark):
    """600 languages, most of them of a few rows: none is left out, and none stops the rest."""
    r = random.Random(6)
    alphabets = [chr(0x4E00 + 20 * k) + chr(0x4E00 + 20 * k + 1) for k in range(600)]
    rows = [(k, "".join(r.choice(alphabets[k % 600]) for _ in range(12)), f"l{k % 600}", "s", 0) for k in range(4800)]
    d = spark.createDataFrame(rows, DOCS)
    m = language.train(d)
    assert len(m.langs) == 600
    got = language.predict(d, m, ("doc_id", "lang")).collect()
    assert len(got) == 4800 and sum(x["lang"] == x["lang_pred"] for x in got) > 4500
    assert language.predict(d.filter("false"), m).count() == 0


def test_ftrl_prunes_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 2 + int(rng.integers(50))]), np.array([1.0, 0.2]), y) for y in rng.integers(0, 2, 300)]
    w = language.ftrl(rows, 2, 60)
    assert w[0].argmax() == 0 and w[1].argmax() == 1 and (w == 0).mean() > 0.2
    y = np.array([0, 1] * 50)
    z = np.eye(2)[y] * 8.0
    z[:20] = z[:20, ::-1]
    assert language.temperature(z, y) > 2


# --- 8 mixing


def test_mixing_budgets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), "en", f"s{i % 5 if r.random() < 0.9 else 0}", 0) for i in range(600)] + [(None, "a b", None, None, 0), (7, None, None, "s1", 0), (8, "q q", None, "s1", 0), (8, "q q", None, "s1", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")).withColumn("range", F.lit(1))
    out = mixing.mix(d).collect()
    assert len(out) == len(rows) and all(0 <= x["taken"] <= 3 * x["size"] for x in out)
    sums = {}
    for x in out:
        s = sums.setdefault((x["source_size"], x["target"]), [0, 0])
        s[0] += x["size"]
        s[1] += x["taken"]
    assert all(k[0] == v[0] and v[1] == int(k[1]) and k[1] <= 3 * k[0] for k, v in sums.items())
    assert abs(sum(k[1] for k in sums) - sum(k[0] for k in sums)) < 1e-6
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, out))
    assert mixing.mix(d.filter("false")).count() == 0


# --- 9 top-k


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(230, 6)) * scale).astype(np.float32)
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (650, [float("inf")] + [0.0] * 5)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("x", F.lit(2))
    c = np.floor(256 * x.astype(float)).astype(object)
    for block in (1024, 2):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(d, F.col("vec_id") % 50 == 0, block=block).collect()} if scale == 1 else None
        if scale != 1:
            with pytest.raises(Exception, match="62 bits"):
                topk.search(d, F.col("vec_id") % 50 == 0, block=block).collect()
            return
        want = {}
        for q in range(0, 230, 50):
            s = sorted(((-int(sum(c[q] * c[j])), j) for j in range(230) if j != q))[:5]
            want |= {(q, k + 1): (j, -v) for k, (v, j) in enumerate(s)}
        assert got == want


def test_mixing_targets_of_huge_sources(spark):
    """Sums near the end of a long, and more sources than one range: exact, and by the plain rule."""
    from fractions import Fraction

    r = random.Random(4)
    sizes = {f"s{k:03d}": r.choice((0, 3, 10**6, 34 * 10**17 // 100)) for k in range(90)}
    got = {x["source"]: (x["s"], x["w"], x["target"]) for x in mixing.targets(spark.createDataFrame([(k, "0", n) for k, n in sizes.items()], "source string, range string, n long")).collect()}
    weight = {k: i % 3 + 1 for i, k in enumerate(sorted(sizes))}
    full = set()
    while True:
        rest = sum(sizes.values()) - 3 * sum(sizes[k] for k in full)
        each = Fraction(rest, sum(weight[k] for k in sizes if k not in full))
        more = {k for k in sizes if 3 * sizes[k] < weight[k] * each}
        if more == full:
            break
        full = more
    assert {k: v[:2] for k, v in got.items()} == {k: (sizes[k], weight[k]) for k in sizes}
    for k, (_, _, t) in got.items():
        assert t == pytest.approx(float(3 * sizes[k] if k in full else weight[k] * each), rel=1e-12)


def test_topk_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5]), (2, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(d, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 256 * 128), (0, 2, 2, -256 * 256 + 128 * 512)]
    assert topk.search(d.filter("false"), F.col("vec_id") == 0).count() == 0


# --- 10 toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    bad = ["grubmouth", "slugface", "wormbrain", "dunghead"]
    common = [filler(k, 1) for k in range(400)]
    out = []
    for i in range(n):
        w = [r.choice(common) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(2, 5) if i % 4 == 0 else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((" ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_held_out():
    m = toxicity.fit(toxic_rows(900, 9))
    held = toxic_rows(200, 10)
    got = [(p >= toxicity.PREDICT, y) for (_, y), p in zip(held, m.scores([t for t, _ in held]))]
    assert sum(p == y for p, y in got) / len(got) > 0.95
    assert m.score("") == m.score(None) < 0.3
    # both classes' dictionaries are trained the same way, and are of one size
    assert len(m.toxic) > 1 and len({len(d) for d in m.ordinary + m.toxic}) == 1


def test_toxicity_on_held_out_labels(spark):
    """Of the labelled rows that the model never saw: recall and precision."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(d, labels)
    held = d.join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(~toxicity.learning()).select("doc_id", "text", "toxic").collect()
    p = m.scores([r["text"] for r in held])
    caught = [x >= toxicity.PREDICT for x, r in zip(p, held) if r["toxic"]]
    wrong = [x >= toxicity.PREDICT for x, r in zip(p, held) if not r["toxic"]]
    assert sum(caught) / len(caught) > 0.35 and sum(wrong) / len(wrong) < 0.03


def test_toxicity_odd_rows(spark):
    d = documents(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (99, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(d, labels)
    assert toxicity.score(d, m).count() == len(ODD) and all(0 <= x["score"] <= 1 for x in toxicity.score(d, m).collect())
    assert toxicity.train(d, labels.filter("false")).score("text") == 0.0
    assert toxicity.score(d.filter("false"), m).count() == 0
    twice = toxicity.score(d, m).filter("doc_id = 4").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    # a text is scored whole: what stands at its end counts like what stands at its start
    fitted = toxicity.fit(toxic_rows(900, 9))
    assert fitted.score("x " * 60_000 + "slugface wormbrain dunghead") > fitted.score("x " * 60_000)


# --- the queries and the pipeline


def test_queries_against_sql(spark):
    import os
    from collections import Counter

    import duckdb

    from quillspark.llm import queries

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        r = c.execute(sql)
        cols = [x[0] for x in r.description]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(x[cols.index(k)] for k in df.columns) for x in r.fetchall()), name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert kept.columns == docs.columns
        sizes.append(kept.count())
        if name == "near_dedup":
            ids = {r["doc_id"] for r in simhash.group(before).filter("doc_id = component_id").collect()}
            assert {r["doc_id"] for r in kept.collect()} == ids
        if name == "secrets":
            assert not any(base_spans(r["text"] or "") for r in kept.collect()) and sizes[-1] == sizes[-2]
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] == sizes[4] > 100
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in kept.collect()}


def test_pipeline_stages_on_odd_rows_and_an_empty_table(spark):
    """Nulls, repeated rows, long texts and columns whose names operators use inside: each stage keeps what it must, and all columns."""
    import corpus_pipeline

    english = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND length(text) > 300").limit(30)
    odd = documents(spark, [*ODD, (7, "a token=abcdefghijkl123 b")])
    docs = english
    for c in [x for x in odd.columns if x not in english.columns]:
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.unionByName(odd).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source")))
    for rows, least in ((docs, 20), (docs.filter("false"), 0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, stage(spark, kept, SF).cache()
            n = kept.count()
            if name != "mixing":
                assert kept.columns == docs.columns, name
                assert n <= before.count()
            assert n >= least, name
        assert {"doc_id", "taken"} <= set(kept.columns)
