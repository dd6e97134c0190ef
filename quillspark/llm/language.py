"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points are hashed into a fixed number of buckets. Document frequencies come
from all learning rows; weights from a bounded sample of them, by follow-the-regularised-leader with
elastic-net penalties; a part of the sample that the weights never saw sets the temperature.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_batches

DIM = 1 << 14
#: Learning rows that the weights are fitted on, about: each language's smallest by a hash of id and text, as many of
#: each as its share of the bound, and LEAST_ROWS at least. A rare language is so learnt like any other.
FIT_ROWS, LEAST_ROWS = 3000, 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001

_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's n-grams and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    total = np.zeros(DIM, np.int64)
    key = c * np.uint64(0x9E3779B97F4A7C15)
    for n in range(3):
        if n:
            if len(c) <= n:
                break
            key = (key[:-1] ^ (key[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n:] * np.uint64(0x94D049BB133111EB)
        for at in range(0, len(key), 1 << 20):
            total += np.bincount((key[at : at + (1 << 20)] >> np.uint64(50)).astype(np.int64), minlength=DIM)
    i = np.flatnonzero(total)
    return i, total[i]


def features(i: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-normalised TF-IDF with logarithmic counts."""
    x = (1 + np.log(n)) * idf[i]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, dim: int = DIM) -> np.ndarray:
    """Weights (dim + 1 x k, the last row the bias) by FTRL-proximal with L1 and L2 penalties, a row at a time."""
    z, n = np.zeros((dim + 1, k)), np.zeros((dim + 1, k))

    def at(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            i, x = np.append(i, dim), np.append(x, 1.0)
            w = at(i)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return at(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _frequencies(batches):
    """Learning rows to one row a task: documents seen and, by bucket, documents that have it (packed)."""
    seen, df = 0, np.zeros(DIM, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            seen += 1
            df[counts(t)[0]] += 1
    i = np.append(np.flatnonzero(df), DIM)
    n = np.append(df[i[:-1]], seen)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n)], ["bucket", "n"])


class Model:
    """langs, weights, idf and temperature; ``predict`` gives (language or und, score)."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float):
        self.langs, self.weights, self.idf, self.heat = langs, weights.astype(np.float32), idf, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
            return "und", 0.0
        i, n = counts(text)
        p = _softmax((features(i, n, self.idf) @ self.weights[i] + self.weights[DIM]) / self.heat)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def learning(docs: DataFrame):
    """The condition that a row may be learnt from: crc32 of its id modulo 3 is not 1 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of the learning rows' text and lang, of all languages that occur. Without any, it predicts und.

    Null texts and languages teach nothing; repeated rows count as often as they occur; other columns are ignored. On
    the driver it holds DIM x languages x 16 bytes while it is fitted, and at most FIT_ROWS + LEAST_ROWS x languages rows.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.filter(learning(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(size)
    found = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in found:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    def packed(batches):
        for b in batches:
            got = [counts(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in got], pa.binary()), b.column(1), b.column(2)], ["i", "n", "lang", "h"])

    quota = {x: max(LEAST_ROWS, round(fit_rows * n / sum(size.values()))) for x, n in size.items()}
    # of each language a share of its rows that holds enough of the smallest: what a task must order is bounded
    below = {x: min(2**63 - 1, int((min(1.0, 4 * quota[x] / n) * 2 - 1) * 2**63)) for x, n in size.items()}
    told = docs.sparkSession.createDataFrame([(x, quota[x], below[x]) for x in langs], "lang string, quota long, below long")
    # (the languages are on the driver already, a row each; so texts stay where they are)
    some = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(told), "lang").filter(F.col("h") <= F.col("below"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    sample = some.withColumn("rank", rank).filter(F.col("rank") <= F.col("quota")).select("text", "lang", "h")
    place = {x: k for k, x in enumerate(langs)}
    data = []
    got = sample.mapInArrow(packed, "i binary, n binary, lang string, h long").collect() if langs else []
    for r in sorted(got, key=lambda r: (r["h"], r["lang"])):
        i = np.frombuffer(r["i"], np.int32)
        data.append((i, features(i, np.frombuffer(r["n"], np.int32), idf), place[r["lang"]]))
    if not data:
        return Model([], np.zeros((DIM + 1, 0)), idf, 1.0)
    held = [d for k, d in enumerate(data) if k % 5 == 0]
    fit = [d for k, d in enumerate(data) if k % 5] or data
    w = ftrl(fit, len(langs))
    logits = np.array([x @ w[i] + w[DIM] for i, x, _ in held])
    return Model(langs, w, idf, temperature(logits, np.array([y for *_, y in held])))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with lang_pred and score, from the whole text alone.

    A null text, or one without letters, is und with score 0. Repeated rows get the same prediction; an empty table
    gives an empty result; columns beside ``keep`` are ignored; texts of any length count whole.
    """
    arrow_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for b in batches:
            got = [m.predict(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double"
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language the model tells with a score of ``least`` or more; und goes.

    Null texts go; repeated rows all stay or all go; an empty table stays empty; columns of any name pass through.
    """
    arrow_batches(docs.sparkSession)
    told, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            got = [told.value.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([x != "und" and p >= least for x, p in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """The predicted language of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = predict(docs, train(docs))
    return p.select("doc_id", (~learning(p)).alias("held_out"), "lang_pred", "score")
