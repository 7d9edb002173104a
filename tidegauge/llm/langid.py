"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text (anything but letters is a
break), as log counts times inverse document frequency, scaled to length 1. The weights are
learnt by follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled rows (about ``per_lang`` rows of each language, by a hash of the id), and a
temperature is fitted on a part of that sample that the weights never saw. The sample reaches
the driver as sparse counts, not as texts. Scoring reads every whole text once, without a shuffle.

Defined cases: a null text, or one without letters, is ``und`` with score 0; a null lang is not
learnt from; without any labelled row all are ``und``; a row without an id is scored but neither
learnt from nor held out; repeated rows are scored each, but learnt from once for an id; very long
texts are read whole; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, small_batches

DIMS = 1 << 15
PER_LANG = 600
UNKNOWN = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


class Grams:
    """Hashed n-gram counts of a text."""

    letters: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> tuple[np.ndarray, np.ndarray]:
        if cls.letters is None:
            cls.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        codes = np.where(cls.letters[codes], codes, 0).astype(np.uint32)
        if not codes.any():
            return np.zeros(0, np.int64), np.zeros(0)
        c = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
        full = c > 0
        hashed = np.concatenate([one[full], two[full[1:] | full[:-1]], three[full[1:-1]]]) >> np.uint32(17)
        counts = np.bincount(hashed, minlength=DIMS)
        found = np.flatnonzero(counts)
        return found, counts[found].astype(np.float64)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIMS + 1) x languages, the last row the bias
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        found, counts = Grams.of(text)
        if not len(found):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4
) -> Model:
    """Follow the regularised leader over (language, features, counts) rows; every fifth row calibrates."""
    langs = sorted({r[0] for r in rows})
    df = np.zeros(DIMS)
    for _, found, _ in rows:
        df[found] += 1
    model = Model(langs, np.log((1 + len(rows)) / (1 + df)) + 1, np.zeros((DIMS + 1, len(langs))))
    if len(langs) < 2:
        return model
    learn = [r for i, r in enumerate(rows) if i % 5 != 4]
    check = [r for i, r in enumerate(rows) if i % 5 == 4] or learn
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(learn)):
            lang, found, counts = learn[i]
            at = np.append(found, DIMS)
            x = np.append(model.vector(found, counts), 1.0)
            zi, ni = z[at], n[at]
            shrunk = np.where(np.abs(zi) <= l1, 0.0, zi - np.sign(zi) * l1)
            w = -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)
            p = _softmax(x @ w)
            p[langs.index(lang)] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
    model.weights = -np.where(np.abs(z) <= l1, 0.0, z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    logits = np.array([model.logits(f, c) for _, f, c in check])
    truth = np.array([langs.index(r[0]) for r in check])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 200))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Grams.of(t or "") for t in batch["text"].to_pylist()]
        found = pa.array([f.astype("<u2").tobytes() for f, _ in rows], pa.binary())
        counts = pa.array([c.astype("<f4").tobytes() for _, c in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["lang"], found, counts], names=["lang", "found", "counts"])


def train(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    """Fit on the rows where ``learn`` holds: their text and lang alone."""
    small_batches(docs.sparkSession)
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sample = sampled(labelled, "lang", per_lang, 11).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    got = sample.select("row.lang", "row.text").mapInArrow(_features, "lang string, found binary, counts binary").collect()
    rows = [(r["lang"], np.frombuffer(r["found"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(float)) for r in got]
    return fit(sorted((r for r in rows if len(r[1])), key=lambda r: (r[1].tobytes(), r[0])))


def identify(docs: DataFrame, learn: Column, held_out: Column, per_lang: int = PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, learn, per_lang)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch["text"].to_pylist()]
            langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], langs, scores], names=["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return texts.mapInArrow(score, OUT)
