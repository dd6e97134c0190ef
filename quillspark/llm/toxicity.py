"""Toxicity by compression distance.

Windows are words. Two zstandard dictionaries are trained, on windows of ordinary text and on what toxic text holds
beyond them: the toxic one is the ordinary one with the telling parts of toxic windows put in front, so that what both
know cancels and only what toxic text alone has makes a window shorter. A window's margin is its length under the ordinary dictionary
less that under the toxic one. Dictionaries are trained in folds of the learning rows; rows that a fold's dictionaries didn't see
calibrate the margin that counts and the document's score, and all folds score together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches, sampled

#: Labelled rows that are learnt from, at most, of each class (the smallest by a hash of the id), and bytes of such a
#: text at most: longer ones teach nothing, but are scored whole like all others.
FIT_ROWS, FIT_TEXT_BYTES = {1: 2000, 0: 3000}, 32_768
#: Bytes of a window, at least and at most (a longer word is several), and of the substrings by which windows are told apart.
LEAST, MOST, SUBSTRING = 3, 40, 5
#: Each byte stands so often, so that what a match costs weighs less against what it saves.
WIDE = 4
#: Bytes of the ordinary dictionary and of what the toxic one adds, at most, before they are widened; bytes of a segment of training.
DICTIONARY_BYTES, TELLING_BYTES, SEGMENT = 6_000, 2_000, 48
#: A substring tells of toxic text if it is in so many toxic texts at least, and the log likelihood ratio of its toxic count against chance is so large.
TEXTS, EVIDENCE = 4, 7.0
FOLDS = 3
#: The same for both dictionaries.
PARAMETERS = {"window_log": 18, "hash_log": 18, "chain_log": 18, "search_log": 8, "min_match": 4, "target_length": 256, "strategy": zstandard.STRATEGY_BTULTRA}
#: Bytes that open every dictionary and every window, so that no window is too small to be compressed.
OPENING = np.random.default_rng(1).integers(0, 256, 96, dtype=np.uint8).tobytes()
PREDICT = 0.7
#: Margins tried, in bytes; the one of least log loss on the rows that the dictionaries didn't see stays.
THRESHOLDS = (1.0, 2.0, 3.0, 4.0)
#: Windows whose margins a task remembers.
KNOWN = 500_000


def windows(text: str | None) -> set[bytes]:
    """The distinct words of a text in lower case, each with the space before it; long ones in pieces that share half."""
    out = set()
    for w in (text or "").lower().encode("utf-8", "replace").split():
        if len(w) <= MOST:
            if len(w) >= LEAST:
                out.add(b" " + w)
        else:
            out.update((b" " + w)[i : i + MOST] for i in range(0, len(w) - MOST // 2, MOST // 2))
    return out


def substrings(window: bytes) -> set[bytes]:
    return {window[i : i + SUBSTRING] for i in range(len(window) - SUBSTRING + 1)}


def wide(b: bytes) -> bytes:
    return np.repeat(np.frombuffer(b, np.uint8), WIDE).tobytes()


def trained(samples: Iterable[bytes], size: int) -> bytes:
    """Content of ``size`` bytes at most that zstandard's trainer finds in the widened samples; of so few that it finds none, the distinct samples, the commonest last."""
    samples = list(samples)
    try:
        return zstandard.train_dictionary(max(256, WIDE * size), [wide(x) for x in samples], k=SEGMENT, d=6, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        often = Counter(samples).most_common()
        return wide(b"".join(x for x, _ in reversed(often))[-size:])


def _compressor(content: bytes):
    p = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(OPENING + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress


def _telling(window: bytes, keep: set[bytes]) -> list[bytes]:
    """The longest parts of a window all of whose substrings are kept."""
    out, start = [], None
    for i in range(len(window) - SUBSTRING + 2):
        if i <= len(window) - SUBSTRING and window[i : i + SUBSTRING] in keep:
            start = i if start is None else start
        elif start is not None:
            out.append(window[start : i + SUBSTRING - 1])
            start = None
    return out


class Pair:
    """An ordinary and a toxic dictionary of one size, and the substrings of the toxic one's own part."""

    def __init__(self, rows: list[tuple[set[bytes], int]]):
        toxic = sum(y for _, y in rows)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        inside: tuple[Counter, Counter] = (Counter(), Counter())
        for ws, y in rows:
            counts[y].update(ws)
            inside[y].update(set().union(*map(substrings, ws)) if ws else ())
        share = toxic / max(1, len(rows))

        def evidence(g: bytes, n: int) -> float:
            e = (n + inside[0][g]) * share
            return n * math.log(n / e) - (n - e) if n > e else 0.0

        keep = {g for g, n in inside[1].items() if n >= TEXTS and evidence(g, n) > EVIDENCE}
        parts = [x for w, n in counts[1].items() for x in _telling(w, keep) for _ in range(n)]
        base = trained((w for w, n in counts[0].items() for _ in range(min(n, 5))), DICTIONARY_BYTES)
        own = trained(parts, TELLING_BYTES) if parts else b""
        self.keep = keep
        self.ordinary = base + np.random.default_rng(2).integers(0, 256, len(own), dtype=np.uint8).tobytes()  # as far away
        self.toxic = base + own

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def margin(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves; 0 of a window that shares no substring with what tells of toxic text, which it can't make much shorter."""
        if self.keep.isdisjoint(substrings(window)):
            return 0
        if "_ready" not in self.__dict__:
            self._ready = _compressor(self.ordinary), _compressor(self.toxic)
        x = OPENING + wide(window)
        a, b = self._ready
        return len(a(x)) - len(b(x))


class Model:
    """Pairs of dictionaries, the margin from which a window counts, and the document's calibration."""

    def __init__(self, pairs: list[Pair], threshold: float = THRESHOLDS[0], weights=None):
        self.pairs, self.threshold, self.weights = pairs, threshold, weights
        self.ordinary, self.toxic = [p.ordinary for p in pairs], [p.toxic for p in pairs]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def margins(self, ws: set[bytes], pairs: list[Pair] | None = None) -> np.ndarray:
        """The mean margins over zero of windows, the largest first."""
        if pairs is not None:
            got = [sum(p.margin(w) for p in pairs) / len(pairs) for w in ws]
        else:
            known = self.__dict__.setdefault("_known", {})
            if len(known) > KNOWN:
                known.clear()
            got = []
            for w in ws:
                if (m := known.get(w)) is None:
                    m = known[w] = sum(p.margin(w) for p in self.pairs) / len(self.pairs)
                if m > 0:
                    got.append(m)
        return np.sort(np.array([m for m in got if m > 0], float))[::-1]

    def features(self, m: np.ndarray, n: int) -> np.ndarray:
        """Bias; the largest margin and the next; how many lie beyond the threshold and by how much, for a document's length; that length."""
        over = np.maximum(m - self.threshold, 0)
        best = np.minimum(np.concatenate((m[:2], [0, 0]))[:2], 12) / 4
        return np.array([1.0, *best, min(over.sum(), 60) / 10, over.sum() / math.sqrt(1 + n), np.count_nonzero(over) / math.sqrt(1 + n), math.log1p(n) / 4])

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        out = []
        for t in texts:
            ws = windows(t)
            out.append(float(1 / (1 + np.exp(-np.clip(self.features(self.margins(ws), len(ws)) @ self.weights, -30, 30)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton steps; the bias isn't penalised."""
    w, r = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + r + 1e-9 * np.eye(len(w)), x.T @ (p - y) + r @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[str, int]], folds: int = FOLDS) -> Model:
    """A model of (text, toxic) rows. Repeated texts share a fold, so that no dictionary has seen what it calibrates."""
    place = {t: k for k, t in enumerate(dict.fromkeys(t for t, _ in rows))}
    seen = [(windows(t), y, place[t] % folds) for t, y in rows]
    parts = [([(w, y) for w, y, k in seen if k != f], [(w, y) for w, y, k in seen if k == f]) for f in range(folds)]
    both = lambda x: len({y for _, y in x}) == 2
    if not both(rows) or not all(both(a) for a, _ in parts):
        return Model([])
    pairs = [Pair(a) for a, _ in parts]
    most = max(len(p.toxic) for p in pairs)
    for p in pairs:  # one size for all
        fill = np.random.default_rng(3).integers(0, 256, most - len(p.toxic), dtype=np.uint8).tobytes()
        p.ordinary, p.toxic = fill + p.ordinary, fill + p.toxic
    m = Model(pairs)
    unseen = [(m.margins(w, [p]), len(w), y) for p, (_, b) in zip(m.pairs, parts, strict=True) for w, y in b]
    y = np.array([y for *_, y in unseen], float)
    best = np.inf
    for t in THRESHOLDS:
        m.threshold = t
        x = np.array([m.features(g, n) for g, n, _ in unseen])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        if (loss := -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) < best:
            best, kept = loss, (t, w)
    m.threshold, m.weights = kept
    return m


def learning():
    """The condition that a row may be learnt from: crc32 of its id modulo 3 is not 1 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, fit_rows: dict[int, int] | None = None) -> Model:
    """A model of labelled learning rows. Without both classes it scores everything 0.

    The label rows are chosen first, so no text is shuffled: their ids, of bounded number, are broadcast.
    A document with several labels takes each of them; labels without a document, null texts and those of more
    than FIT_TEXT_BYTES are left out; of repeated rows each counts. Extra columns are ignored.
    """
    fit_rows = fit_rows or FIT_ROWS
    rows = []
    for y, n in sorted(fit_rows.items()):
        mine = labels.filter(learning() & (F.col("toxic") == y)).select("doc_id", F.xxhash64("doc_id").alias("h"))
        ids = sampled(mine, "h", n, mine.count()).distinct().orderBy("h", "doc_id").limit(n).select("doc_id")
        ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long")
        got = docs.filter(F.octet_length("text") <= FIT_TEXT_BYTES).select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(n)
        rows += [(r["text"], y) for r in got.collect()]
    return fit(rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row, from the whole text alone, however long.

    Null and empty texts are scored as texts without windows; repeated rows get the same score; an empty table
    gives an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for b in batches:
            s = m.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= PREDICT) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return s.select("doc_id", (~learning()).alias("held_out"), "score", "predicted")
