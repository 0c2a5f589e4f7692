"""Operator 3: document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by
the shares of its byte classes, its word lengths and its repetitions, and encoded
by a tanh layer. A gated attention (tanh and sigmoid branches, Ilse et al. 2018)
weighs the encoded passages, and a logistic unit scores their weighted mean. Only
document labels are learned from; the attention finds the passages that tell.

The model is fitted on the driver with numpy on at most FIT_DOCS labelled
documents (those of the least seeded hash) and FIT_PASSAGES passages of each, so on
100 MB at most; it has a few thousand numbers and is sent to the executors, which
score every whole text, all its passages, in one pass without a shuffle.

Defined cases:

* a null, empty or blank text is a bag of one passage without words, and gets a score like any other;
* labels that are null, and labels without a document, are not learned from; a document with several labels counts once
  for each; without any label every score is 0.5;
* rows with equal or null ``doc_id`` are scored one by one (a null id is hashed as the empty text);
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkit
from .common import small, table

#: Words of a passage; labelled documents that a model is fitted on, at most, and passages of each (evenly spaced ones of longer documents).
PASSAGE, FIT_DOCS, FIT_PASSAGES = 64, 6000, 128
#: Units of the encoder and of the attention; passes over the fitted documents; documents a step.
HIDDEN, ATTENTION, EPOCHS, BATCH = 24, 12, 40, 128
#: A document is kept at this score.
KEEP = 0.3
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\v\f\r", b".", b",", b"!", b"?", b"|", b"\"'", b"#$%&*@^~`", b"<>{}[]()", b"-_", b"/:;=+\\")
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i + 1
_CLASS[0x80:0xC0] = len(_CLASSES) + 1
_CLASS[0xC0:] = len(_CLASSES) + 2
_N = len(_CLASSES) + 3
FEATURES = _N + 9


def _ratio_distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Distinct values in each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=groups)


def features(data: np.ndarray, off: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the rows in (data, off), and the index of each row's first passage."""
    start, end, first = textkit.word_bounds(data, off)
    words = np.diff(first)
    count = np.maximum(-(-words // passage), 1)
    at = np.concatenate([[0], np.cumsum(count)])
    n = int(at[-1])
    row_of_word = np.repeat(np.arange(len(words)), words)
    rank = np.arange(len(start)) - first[row_of_word] if len(start) else np.zeros(0, np.int64)
    of = at[row_of_word] + rank // passage if len(start) else np.zeros(0, np.int64)
    # A passage's bytes go from its first word (a row's first: from the row's begin) to the next passage's.
    head = np.full(n, -1, np.int64)
    head[at[:-1]] = off[:-1]
    lead = np.flatnonzero((rank % passage == 0) & (rank > 0))
    head[of[lead]] = start[lead]
    size = np.diff(np.append(head, len(data)))
    chars = np.bincount(np.repeat(np.arange(n) * _N, size) + _CLASS[data], minlength=n * _N).reshape(n, _N)
    h = textkit.word_hashes(data, start, end, lower=False)
    length = (end - start).astype(float)
    w = np.bincount(of, minlength=n).astype(float)
    one = np.maximum(w, 1)
    mean = np.bincount(of, length, n) / one
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / one - mean**2, 0))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    # Words whose pair with the next word stands elsewhere in the document too.
    copied = np.zeros(len(h))
    if len(h) > 1:
        with np.errstate(over="ignore"):
            pair = textkit.mix64(h[:-1] * np.uint64(3) + h[1:])
        near = row_of_word[1:] == row_of_word[:-1]
        key = textkit.mix64(pair ^ row_of_word[:-1].astype(np.uint64))[near]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        copied[np.flatnonzero(near)] = times[inverse] > 1
    out = np.empty((n, FEATURES), np.float32)
    out[:, :_N] = np.sqrt(chars / np.maximum(size, 1)[:, None])
    out[:, _N:] = np.column_stack([w / passage, np.log1p(np.repeat(words, count)), mean / 8, spread / 8, np.bincount(of, again, n) / one, _ratio_distinct(of, h, n) / one, np.bincount(of, copied, n) / one, np.bincount(of, length <= 3, n) / one, np.bincount(of, length > 20, n) / one])
    return out, at


def bags(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, features, index of each row's first passage) over a text column."""
    for lo, hi, data, off in textkit.slices(text):
        yield lo, hi, *features(data, off)


@dataclass
class Model:
    """Encoder (w1, b1), gated attention (v, u, w) and output (c, d), over standardised features."""

    mean: np.ndarray
    std: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p, lo = self.p, at[:-1]
        h = np.tanh(x @ p["w1"] + p["b1"])
        tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (tv * su) @ p["w"]
        n = np.diff(at)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, lo), n))
        a /= np.repeat(np.add.reduceat(a, lo), n)
        z = np.add.reduceat(h * a[:, None], lo, axis=0)
        return {"h": h, "tv": tv, "su": su, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x.astype(float)), at)["p"]

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, n = self.p, self.forward(x, at), np.diff(at)
        ds = (f["p"] - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"][None, :], n, axis=0)
        da = (dz * f["h"]).sum(1)
        da = f["a"] * (da - np.repeat(np.add.reduceat(da * f["a"], at[:-1]), n))
        dg = da[:, None] * p["w"][None, :]
        dv, du = dg * f["su"] * (1 - f["tv"] ** 2), dg * f["tv"] * f["su"] * (1 - f["su"])
        dh = (f["a"][:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w1": x.T @ dh, "b1": dh.sum(0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "w": (f["tv"] * f["su"]).T @ da, "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit by Adam on the log loss with a small weight decay."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    params = {"w1": draw(x.shape[1], HIDDEN), "b1": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
    x = x.astype(float)
    model = Model(x.mean(0), x.std(0) + 1e-3, params)
    x, n = model.scaled(x), np.diff(at)
    m1, m2, step = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), 0.01 * (1 - epoch / epochs) + 5e-4
        for b in range(0, len(y), BATCH):
            rows = order[b : b + BATCH]
            some = np.concatenate([[0], np.cumsum(n[rows])])
            take = np.repeat(at[rows] - some[:-1], n[rows]) + np.arange(some[-1])
            step += 1
            for k, g in model.gradients(x[take], some, y[rows]).items():
                g = g + 1e-4 * params[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                params[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, x, at in bags(batch.column("text")):
            rows = [np.arange(at[i], at[i + 1]) for i in range(hi - lo)]
            rows = [r if len(r) <= FIT_PASSAGES else r[np.linspace(0, len(r) - 1, FIT_PASSAGES).astype(int)] for r in rows]
            flat = pa.array([x[r].tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), flat], ["label", "bag"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS) -> Model | None:
    """A model from docs(doc_id, text) and labels(doc_id, label), but for held-out rows; None without labels."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    some = some.orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), "doc_id", "label").limit(fit_docs)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(some, fit_docs), "doc_id").select("doc_id", "label", "text")
    rows = text.select("label", "text", "doc_id").mapInArrow(_with_id, "doc_id long, label int, bag binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["bag"])))
    each = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]), np.array([float(r["label"] > 0) for r in rows]))


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for out in _bags(iter([batch])):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, out.num_rows).cast(pa.int64()), out.column(0), out.column(1)], ["doc_id", "label", "bag"])
            done += out.num_rows


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) in a column of that name, which replaces one that is there."""
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            for lo, hi, x, at in bags(batch.column(text)):
                out[lo:hi] = model.score(x, at)
            yield batch.append_column(name, pa.array(out))

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
