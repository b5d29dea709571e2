"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 characters of
the lower-cased text in which everything but letters is one space): the whole
text, sublinear term frequency, unit length.

- Document frequencies are counted over all documents that may be learned from.
- The model is fitted on a bounded sample of them (``max_train`` rows, the
  smallest hashes of doc_id), by follow-the-regularised-leader with per-weight
  steps and elastic-net penalties, which leaves most weights at zero.  A fifth
  of the sample is set apart for the temperature that calibrates the scores.
- Prediction is one pass over the texts with the weights broadcast; their size
  is fixed by ``bits`` and the number of languages.

Only vectors of at most 2**bits places reach the driver, never texts.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Rows
without a language, or held out, teach nothing.  If nothing can be learned from,
every row is ``und``.  Repeated rows keep a row each.  Ties go to the language
that sorts first.  An empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import held_out, in_arrow, slices

BITS = 15
MAX_TRAIN = 4000
_SPREAD = np.array([0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-cased letter, or 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray | None:
    """Counts of the text's hashed character n-grams; None if it has no letter."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return None
    run = space[1:] & space[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[np.concatenate(([True], ~run))], [np.uint32(32)]))
    counts, shift = np.zeros(1 << bits, np.int64), np.uint32(32 - bits)
    value = np.zeros(len(codes), np.uint32)
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        value = value[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        hashed = (value ^ (value >> np.uint32(15))) * _SPREAD[n]
        counts += np.bincount((hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x2C1B3C6D) >> shift, minlength=1 << bits)
    return counts


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF weights of a text, of unit length."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places x labels
    bias: np.ndarray
    temperature: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        at, x = vector(counts, self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many of the texts hold each n-gram place, and how many have a letter."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text, bits) if text else None
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros((1 << bits) + 1, np.int64)
    for r in in_arrow(docs.select("text"), step, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas().itertuples():
        out[r.place] = r.n
    return out[:-1], int(out[-1])


def sample(docs: DataFrame, usable: Column, label: str, most: int) -> DataFrame:
    """The ``most`` usable rows whose doc_id hashes smallest, found without their texts."""
    h = F.xxhash64("doc_id")
    last = docs.filter(usable).select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    rows = docs.filter(usable & (h <= F.lit(last if last is not None else 0))).select(h.alias("h"), F.col(label).alias("label"), "text")
    return rows.orderBy("h").limit(most) if last is not None else rows.limit(0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int | np.ndarray]], n_labels: int, places: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (places x labels) and bias of the proximal follow-the-regularised-leader.

    A row is its places, their values, and a label or the labels' probabilities.
    """
    z, n = np.zeros((places + 1, n_labels)), np.zeros((places + 1, n_labels))
    rng = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, places), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            if isinstance(y, int):
                p[y] -= 1.0
            else:
                p -= y
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, usable: Column, max_train: int = MAX_TRAIN, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> Model:
    """Fit a model to the ``usable`` rows of ``docs`` (doc_id, text, lang)."""
    frequency, n_docs = document_frequencies(docs.filter(usable), bits)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"h": [], "label": [], "at": [], "x": []}
            for h, label, text in zip(*[batch.column(c).to_pylist() for c in ("h", "label", "text")], strict=True):
                counts = ngram_counts(text, bits) if text else None
                if counts is not None:
                    at, x = vector(counts, idf)
                    for c, v in (("h", h), ("label", label), ("at", at.astype(np.int32)), ("x", x.astype(np.float32))):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("label", pa.string()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    vectors = in_arrow(sample(docs, usable, "lang", max_train).repartition(16), step, "h long, label string, at array<int>, x array<float>").toArrow()
    got = sorted(zip(vectors["h"].to_pylist(), vectors["label"].to_pylist(), [np.asarray(v.values) for v in vectors["at"]], [np.asarray(v.values, dtype=np.float64) for v in vectors["x"]], strict=True), key=lambda r: (r[0], r[1]))
    labels = sorted({r[1] for r in got})
    rows = [(at, x, labels.index(label)) for _, label, at, x in got]
    fit, rest = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    weights, bias = ftrl(fit or rows, len(labels), 1 << bits, alpha, beta, l1, l2, epochs) if labels else (np.zeros((1 << bits, 0)), np.zeros(0))
    logits = np.array([x @ weights[at] + bias for at, x, _ in rest]).reshape(len(rest), len(labels))
    return Model(labels, idf, weights, bias, temperature(logits, np.array([y for *_, y in rest], dtype=int)))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep``, as _0, _1, ..., with lang_pred and score for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.idf)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(read).to_pylist():
                counts = ngram_counts(text, bits) if text and m.labels else None
                if counts is None:
                    names.append("und")
                    scores.append(0.0)
                else:
                    p = m.scores(counts)
                    names.append(m.labels[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f"_{i}") for i in range(len(keep))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[f"_{i}" for i in range(len(keep))], "lang_pred", "score"])

    read = f"_{keep.index('text')}" if "text" in keep else "_text"  # texts go to Python once
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], *[F.col("text").alias(c) for c in [read] if c == "_text"])
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return in_arrow(rows, step, schema)


def usable_for_language() -> Column:
    return ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    model = train(docs, usable_for_language(), max_train)
    return predict(docs, model, "doc_id").withColumnRenamed("_0", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scored under ``least``."""
    model = train(docs, usable_for_language(), max_train)
    names = docs.columns
    kept_rows = predict(docs, model, *names).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept_rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
