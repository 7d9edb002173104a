"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are alike by the character triples they share in order, gaps allowed, each weighted by
a decay to the power of its spread; an insult with inserted or dropped characters keeps most of
its triples. Landmarks are the words that tell toxic from other labelled texts best. A text is
described by its best kernel value against each landmark over all its words, mapped by the
inverse root of the landmarks' kernel matrix (Nystroem); a squared-hinge machine is fitted in
that space, and Platt's sigmoid turns its margin into a score. Runs of single characters are
read as one word, and marks inside a word are ignored.

Fitting uses a bounded sample of labelled rows (about ``per_class`` of each label, by a hash of
the id); the driver gets landmark words and one short vector per sampled text. Scoring reads
every whole text once, without a shuffle; each worker remembers word vectors up to a bound.

Defined cases: a null or empty text is scored as one without words; labels that are null are not
learnt from, several for one id count as their largest; without both labels every score is 0;
repeated rows are scored each, but learnt from once for an id; a row without an id is scored,
neither learnt from nor held out; very long texts are read whole; an empty table gives an empty
result; further columns are ignored, and ``keep_clean`` passes them through whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, sampled, small_batches

PER_CLASS = 3000
LANDMARKS = 160
POWER = 2  # the kernel's power, itself a kernel: near doubles count, chance likeness does not
DECAY = 0.6
BLUR, EXTRA = 0.65, 0.1  # kernel value of an insult with a character inserted; weight of such rows
REACH = 4  # a triple's last character is at most this far from its first
TOXIC = 0.5  # least score of a toxic text
FLOOR = 0.4  # kernel values below this count as 0
SHAPES = [(b, c) for b in range(1, REACH) for c in range(b + 1, REACH + 1)]
LONGEST = 24
SLOTS = 1 << 15
KNOWN_WORDS = 100_000  # in each of two generations
PART = 8192  # words whose kernel values are found at once
SINGLES = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
OUT = "doc_id long, held_out boolean, score double, predicted int"


def _alphabet() -> np.ndarray:
    """Six bits: base letters 1-26, start 27, other letters 28, digits 29, Latin-1's own letters 30-62, end 63, marks 0."""
    out = np.zeros(0x3000, np.int64)
    for i in range(len(out)):
        low = chr(i).lower()[0]
        base = unicodedata.normalize("NFD", low)[0]
        if 0xDF <= ord(low) <= 0xFF and low.isalpha():
            out[i] = 30 + ord(low) - 0xDF
        elif "a" <= base <= "z":
            out[i] = ord(base) - 96
        elif base.isalpha():
            out[i] = 28
        elif base.isdigit():
            out[i] = 29
    out[0] = 63
    return out


CODES = _alphabet()


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words; single characters in a row are one word."""
    if not text:
        return set()
    text = text.lower()
    words = set(text.split())
    if any(len(w) == 1 for w in words):
        words.update(re.sub(r"\s+", "", m) for m in SINGLES.findall(text))
    return words


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes, marks removed, and the word each row is from; long words give overlapping rows."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer("".join([w + "\0" for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    flat = np.where(flat < len(CODES), CODES[np.minimum(flat, len(CODES) - 1)], 28)
    word = np.repeat(np.arange(len(words)), sizes)[flat > 0]
    flat = flat[flat > 0]
    sizes = np.bincount(word, minlength=len(words))
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    half = LONGEST // 2
    rows_each = np.maximum(1, -(-sizes // half) - 1)
    first_row = np.cumsum(rows_each) - rows_each
    out = np.zeros((int(rows_each.sum()), LONGEST + 1), np.int64)
    owner = np.repeat(np.arange(len(words)), rows_each)
    for shift in (0, 1):  # each character lies in up to two overlapping rows
        k = place // half - shift
        ok = (k >= 0) & (k < rows_each[word])
        out[first_row[word[ok]] + k[ok], 1 + place[ok] - k[ok] * half] = flat[ok]
    out[first_row, 0] = 27
    return out, owner


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each triple by shape and place (0: none), and the weights by column."""
    width = codes.shape[1]
    index, weight = [], []
    for b, c in SHAPES:
        if width <= c:
            continue
        x, y, z = codes[:, : width - c], codes[:, b : width - c + b], codes[:, c:]
        index.append(np.where((x > 0) & (y > 0) & (z > 0), ((x * 4096 + y * 64 + z) * 40503 >> 6) % SLOTS, 0))
        weight.append(np.full(width - c, DECAY ** (c - 2)))
    return np.concatenate(index, 1), np.concatenate(weight)


def dense(words: list[str]) -> np.ndarray:
    """Scaled triple weights of each word, 32768 wide."""
    out = np.zeros((len(words), SLOTS), np.float32)
    codes, owner = _coded(words)
    index, weight = _triples(codes)
    np.add.at(out, (owner[:, None], index), np.broadcast_to(weight, index.shape))
    out[:, 0] = 0
    norm = np.sqrt((np.where(index > 0, weight, 0) ** 2).sum(1))
    return out / np.maximum(np.bincount(owner, norm**2, len(words)) ** 0.5, 1e-6)[:, None].astype(np.float32)


def compact(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' triple weights without the slots that none of them has: each slot's row (0: none), and the rows by word."""
    found = []
    for at in range(0, len(words), 16):
        part = dense(words[at : at + 16])
        word, slot = np.nonzero(part)
        found.append((word + at, slot, part[word, slot]))
    word, slot, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.zeros(SLOTS, np.int32)
    used = np.unique(slot)
    rows[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(words)), np.float32)
    table[rows[slot], word] = weight
    return rows, table


def kernel(words: list[str], slots: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel values of at least FLOOR: word, landmark, value. ``slots`` and ``landmarks`` are from ``compact``.

    A word's value is at most the share of its own weight that lies in the landmarks' slots, so
    the words with less than FLOOR of it there are passed over without loss."""
    codes, owner = _coded(words)
    lengths = (codes > 0).sum(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in ((3, 8), (8, 13), (13, LONGEST + 1)):
        pick = np.flatnonzero((lengths > low) & (lengths <= high))
        for at in range(0, len(pick), 2048):
            rows = pick[at : at + 2048]
            index, weight = _triples(codes[rows, :high])
            squares = weight**2
            norm = (index > 0) @ squares
            index = slots[index]
            likely = np.flatnonzero((index > 0) @ squares >= FLOOR**2 * norm)
            if not len(likely):
                continue
            rows, index, norm = rows[likely], np.ascontiguousarray(index[likely].T), np.sqrt(norm[likely]).astype(np.float32)
            values = np.zeros((len(rows), landmarks.shape[1]), np.float32)
            for column, part in zip(index, weight, strict=True):
                used = np.flatnonzero(column)
                if len(used):
                    values[used] += np.float32(part) * landmarks[column[used]]
            values /= np.maximum(norm, 1e-6)[:, None]
            r, c = np.nonzero(values >= FLOOR)
            found.append((owner[rows[r]], c, values[r, c]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Machine:
    landmarks: list[str] = field(default_factory=list)
    whiten: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)

    def learn(self, words: set[str]) -> None:
        """Remember the kernel values of new words; most words have none. A word that does not come
        again in a generation of KNOWN_WORDS is forgotten: most words that come once come only once."""
        if not hasattr(self, "_table"):
            self._table = compact(self.landmarks)
            self._known: dict[str, tuple | None] = {}
            self._older: dict[str, tuple | None] = {}
        if len(self._known) > KNOWN_WORDS:
            self._older, self._known = self._known, {}
        unknown = words - self._known.keys()
        again = unknown & self._older.keys()
        self._known.update((w, self._older[w]) for w in again)
        new = list(unknown - again)
        for at in range(0, len(new), PART):
            part = new[at : at + PART]
            self._known.update(dict.fromkeys(part))
            word, mark, value = kernel(part, *self._table)
            order = np.argsort(word, kind="stable")
            cuts = np.flatnonzero(np.diff(word[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                self._known[part[word[rows[0]]]] = (mark[rows], value[rows])

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """Each text's best kernel value by landmark."""
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for first in range(0, len(texts), 200):
            sets = [words_of(t) for t in texts[first : first + 200]]
            self.learn(set().union(*sets))
            for row, words in enumerate(sets, first):
                if hits := list(filter(None, map(self._known.__getitem__, words))):
                    np.maximum.at(out[row], *(np.concatenate(x) for x in zip(*hits, strict=True)))
        return out**POWER

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return (pooled @ self.whiten) @ self.weights + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margin(self.pooled(texts)) + b, -40, 40)))

    def forget(self) -> None:
        """The end of a task: the words' vectors go, and freed memory with them."""
        for name in [n for n in self.__dict__ if n.startswith("_")]:
            del self.__dict__[name]
        give_back()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """Newton's method in the primal."""
    x1 = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        active = y * (x1 @ w) < 1
        xa, ca = x1[active], (cost * weight[active])[:, None]
        new = np.linalg.solve(ridge + 2 * xa.T @ (ca * xa), 2 * xa.T @ (ca[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid_fit(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's scaling with his targets, by Newton's method."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[f, np.ones(len(f))], np.array([1.0, 0.0])
    loss = lambda v: (weight * (np.logaddexp(0, x @ v) - target * (x @ v))).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - target))
        step = np.linalg.solve(x.T @ ((weight * p * (1 - p))[:, None] * x) + 1e-9 * np.eye(2), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def fit(landmarks: list[str], pooled: np.ndarray, toxic: np.ndarray, prior: float, cost: float = 10.0) -> Machine:
    """Fit the machine on pooled kernel values; ``prior`` is the share of toxic among all labelled rows."""
    machine = Machine(landmarks)
    table = dense(landmarks)
    gram = (table @ table.T).astype(np.float64)
    values, vectors = np.linalg.eigh(np.where(gram >= FLOOR, gram, 0) ** POWER)
    machine.whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    x, y = pooled.astype(np.float64) @ machine.whiten, np.where(toxic > 0, 1.0, -1.0)
    share = (y > 0).mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    # each toxic text again with its insults blurred, and with nothing but its insults
    hit = pooled[y > 0] >= 0.9**POWER
    blurred, bare = np.where(hit, BLUR**POWER, pooled[y > 0]), np.where(hit, pooled[y > 0], 0)
    more = np.r_[blurred, bare].astype(np.float64) @ machine.whiten
    more_y, more_weight = np.ones(len(more)), np.full(len(more), EXTRA * prior / share)
    # and a text without anything near a landmark, which is not toxic
    more, more_y = np.r_[more, np.zeros((1, more.shape[1]))], np.r_[more_y, -1.0]
    more_weight = np.r_[more_weight, 2 * EXTRA * weight.sum()]
    out = np.zeros(len(y))
    for part in range(3):
        test = np.arange(len(y)) % 3 == part
        if len(set(y[~test])) == 2:
            w, b = _squared_hinge(x[~test], y[~test], weight[~test], cost)  # scores for the sigmoid: out of fold
            out[test] = x[test] @ w + b
    machine.weights, machine.bias = _squared_hinge(np.r_[x, more], np.r_[y, more_y], np.r_[weight, more_weight], cost)
    machine.platt = _sigmoid_fit(out, y, weight)
    return machine


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [[w for w in words_of(t) if len(w) <= 4 * LONGEST] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])
    words = batch = None
    give_back()


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, n_landmarks: int = LANDMARKS) -> Machine:
    """Fit on labelled rows where ``learn`` (of doc_id) holds: their text and toxic alone."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(learn)
    sizes = {int(r["toxic"] > 0): r["count"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if len(sizes) < 2:
        return Machine()
    chosen = sampled(marked.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic", per_class, 5)
    chosen = chosen.select(F.col("doc_id").alias("id2"), "toxic")  # about 2 x per_class rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id2"))
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    words = sample.select("toxic", "text").mapInArrow(_words, "toxic int, words array<string>")
    n1, n0 = (float(max(1, min(per_class, sizes[c]))) for c in (1, 0))
    by_word = words.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    share = n1 / (n1 + n0)  # the word's log-likelihood ratio, where toxic texts have it more often
    part = lambda x, expected: F.when(x > 0, x * F.ln(x / expected)).otherwise(0.0)
    told = (part(a, (a + b) * share) + part(b, (a + b) * (1 - share))).alias("z")
    more = by_word.where((a >= 2) & (F.length("word") >= 3) & (a > (a + b) * share))
    best = more.select("word", told).orderBy(F.desc("z"), "word").limit(4 * n_landmarks)
    ranked = [r["word"] for r in best.collect()]
    if not ranked:
        return Machine()
    table, picked = dense(ranked), [0]
    while len(picked) < min(n_landmarks, len(ranked)):  # the best words first, near doubles of a chosen one last
        near = (table @ table[picked].T).max(1)
        near[picked] = 9
        picked.append(int(np.argmin(np.where(near < 0.8, np.arange(len(ranked)), len(ranked) + near * len(ranked)))))
    landmarks = [ranked[i] for i in picked]
    blank = Machine(landmarks)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            rows = [v.astype("<f4").tobytes() for v in blank.pooled(texts)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(rows, pa.binary())], names=["doc_id", "toxic", "v"])
        blank.forget()

    got = sorted(sample.mapInArrow(pool, "doc_id long, toxic int, v binary").collect(), key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["v"]))
    if len({r["toxic"] for r in got}) < 2:
        return Machine()
    pooled = np.array([np.frombuffer(r["v"], "<f4") for r in got])
    return fit(landmarks, pooled, np.array([r["toxic"] for r in got]), sizes[1] / (sizes[0] + sizes[1]))


def detect(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, learn, per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = machine.scores(batch["text"].to_pylist())
            columns = [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array((scores >= TOXIC).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])
        machine.forget()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return texts.mapInArrow(score, OUT)


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, all columns unchanged."""
    machine = train(docs, labels, learn, per_class)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(machine.scores(batch.column(at).to_pylist()) < TOXIC, pa.bool_()))
        machine.forget()

    return docs.mapInArrow(clean, docs.schema)
