"""SentencePiece encoding and decoding by a max-plus scan.

A text is cut into the pieces whose scores add up to the most; characters that no piece covers
become byte pieces at a penalty. The best cut is a max-plus product of per-character transfer
matrices, which is associative. A giant text is dealt into chunks over the cluster: a chunk's
matrix holds the best score from each entry state to each exit state (how far the piece that
crosses the boundary reaches over it), neighbouring matrices are multiplied level by level, the
boundary states follow from the top level down, and each chunk is then backtraced by itself. Texts below ``GIANT`` characters take the
same dynamic programme word by word, as pieces never run on into another word's blank; words
are remembered up to a bound. (A vocabulary whose pieces do is run over whole texts.)

The scores are those of the model file. For a unigram model this is the library's own result;
the public model here was built by merging, and for it the cut is the best-scoring one over its
vocabulary, which need not be the library's sequence of merges. Decoding is exact either way.

Defined cases: null text counts as empty, without tokens; ties go to the longer last piece within
a chunk and to the smaller entry state between chunks; repeated rows are encoded each; an empty
table gives an empty result; only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

GIANT, CHUNK = 50_000, 10_000
FANOUT = 64  # matrices multiplied by one task
PENALTY = 10.0
LOW = -1e300
WORDS_KEPT = 300_000
UNITS = re.compile(" +[^ ]*|[^ ]+")
WORD_STARTS = re.compile("(?<=[^ ]) ")


class Pieces:
    """The vocabulary by piece, with blanks as blanks, and the dynamic programme over it."""

    loaded: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.out: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.score[piece.replace("▁", " ")] = (sp.get_score(i), i)
                self.out.append(piece.replace("▁", " ").encode())
        self.longest = max(map(len, self.score))
        self.by_word = not any(re.search("[^ ] ", p) for p in self.score)
        self.fallback = min(s for s, _ in self.score.values()) - PENALTY
        from tokenizers.models import Unigram

        #: the same dynamic programme, compiled, for words; number 0 is what no piece covers
        self.numbers = [0, *(i for _, i in self.score.values())]
        self.compiled = Unigram([("<unk>", 0.0), *((p, s) for p, (s, _) in self.score.items())], 0)
        #: pieces, and None for what only begins a piece
        self.begins: dict[str, tuple[float, int] | None] = {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score
        self.known: dict[str, bytes] = {}
        self.scores: dict[str, float] = {}

    def steps(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """Pieces that start at a place: length and score."""
        single = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            found = self.begins.get(text[at : at + n], 0)
            if found == 0:
                break
            if found:
                single |= n == 1
                yield n, found[0]
        if not single:
            yield 1, self.fallback

    def path(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """Ids of the best cut of text[start:end]."""
        end = len(text) if end is None else end
        size = end - start
        best, back, get, longest = [LOW] * (size + 1), [0] * (size + 1), self.begins.get, self.longest
        best[0] = 0.0
        for i in range(size):
            here = best[i]
            if here <= LOW:
                continue
            at = start + i
            single = False
            for j in range(i + 1, min(i + longest, size) + 1):
                found = get(text[at : start + j], 0)
                if found == 0:
                    break
                if found:
                    single |= j == i + 1
                    if here + found[0] > best[j]:
                        best[j], back[j] = here + found[0], i
            if not single:
                if here + self.fallback > best[i + 1]:
                    best[i + 1], back[i + 1] = here + self.fallback, i
        cuts, at = [], end - start
        while at > 0:
            cuts.append((back[at], at))
            at = back[at]
        out = []
        for i, j in reversed(cuts):
            piece = text[start + i : start + j]
            if piece in self.score:
                out.append(self.score[piece][1])
            else:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def parts(self, text: str, n: int) -> tuple[int, int] | None:
        """Where the first whole word of a chunk starts beyond every entry state, and where its last one does."""
        starts = [m.start() for m in WORD_STARTS.finditer(text, self.longest - 1, n)] if self.by_word else []
        return (starts[0], starts[-1]) if starts else None

    def matrix(self, text: str, n: int) -> np.ndarray:
        """Best scores from entry state to exit state of the chunk text[:n]; the rest looks ahead.

        No piece crosses the start of a word, so between two such places the states meet in one:
        the matrix is the outer sum of its first and last words' vectors and the words between."""
        cut = self.parts(text, n)
        if cut is None:
            return self.product(text, n)
        first, last = cut
        middle = sum(map(self.worth, UNITS.findall(text[first:last])))
        return self.product(text[:first], first)[:, :1] + middle + self.product(text[last:], n - last)[:1]

    def trace(self, text: str, n: int, entry: int, leave: int) -> bytes:
        """Ids of the best cut of a chunk between known boundary states."""
        cut = self.parts(text, n)
        if cut is None:
            return np.array(self.path(text, entry, n + leave), "<u4").tobytes()
        first, last = cut
        ends = self.path(text, entry, first), self.path(text, last, n + leave)
        words = b"".join(map(self.remembered, UNITS.findall(text[first:last])))
        return np.array(ends[0], "<u4").tobytes() + words + np.array(ends[1], "<u4").tobytes()

    def product(self, text: str, n: int) -> np.ndarray:
        """The matrix of text[:n], character by character."""
        width = self.longest
        best = np.full((n + width, width), LOW)
        best[np.arange(width), np.arange(width)] = 0.0
        for i in range(n):
            row = best[i]
            if row.max() > LOW:
                for m, score in self.steps(text, i):
                    if i + m < n + width:
                        np.maximum(best[i + m], row + score, out=best[i + m])
        return best[n : n + width].T.copy()

    def word(self, unit: str) -> bytes:
        """The best cut of one word with its blanks."""
        ids: list[int] = []
        for token in self.compiled.tokenize(unit):
            if token.id:
                ids.append(self.numbers[token.id])
            else:
                ids += [self.bytes[b] for b in token.value.encode("utf-8", "surrogatepass")]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        text = " " + text
        if not self.by_word:
            return np.array(self.path(text), "<u4").tobytes()
        return b"".join(map(self.remembered, UNITS.findall(text)))

    def remembered(self, unit: str) -> bytes:
        ids = self.known.get(unit)
        if ids is None:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            ids = self.known[unit] = self.word(unit)
        return ids

    def worth(self, unit: str) -> float:
        """Score of a word's best cut."""
        score = self.scores.get(unit)
        if score is None:
            if len(self.scores) > WORDS_KEPT:
                self.scores.clear()
            tokens = self.compiled.tokenize(unit)
            score = self.scores[unit] = sum(self.score[t.value][0] if t.id else self.fallback * len(t.value) for t in tokens)
        return score

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")[1:]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product, in order."""
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(1)
    return out


def fold(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the best path through all, from entry to leave."""
    values = [np.full(len(matrices[0]), LOW)]
    values[0][entry] = 0.0
    for m in matrices:
        values.append((values[-1][:, None] + m).max(0))
    state, out = leave, []
    for m, value in zip(reversed(matrices), reversed(values[:-1]), strict=True):
        before = int(np.argmax(value + m[:, state]))
        out.append((before, state))
        state = before
    return out[::-1]


def _bounds(scored: DataFrame, width: int, most: int) -> DataFrame:
    """Boundary states (fp, c, entry, leave) of the chunks scored (fp, c, m), by a scan in levels.

    Up: the matrices of FANOUT neighbours are multiplied into one, until a text has FANOUT at most;
    the products of a level are independent. Down: with its entry and exit known, each product is
    folded open into those of its members. No task holds more than FANOUT matrices of a text's."""
    read = lambda column: [np.frombuffer(m).reshape(width, width) for m in column]

    def multiplied(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        return pd.DataFrame({"fp": group["fp"].iloc[:1], "c": group["up"].iloc[:1], "m": [product(read(group["m"])).tobytes()]})

    def opened(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        found = fold(read(group["m"]), int(group["entry"].iloc[0]), int(group["leave"].iloc[0]))
        return pd.DataFrame({"fp": group["fp"], "c": group["c"], "entry": [a for a, _ in found], "leave": [b for _, b in found]})

    up = F.floor(F.col("c") / FANOUT).alias("up")
    levels = [scored]
    while most > FANOUT:
        most = -(-most // FANOUT)
        levels.append(stage(levels[-1].select("fp", "c", "m", up).groupBy("fp", "up").applyInPandas(multiplied, "fp long, c long, m binary"), "scan-level"))
    zero = F.lit(0)
    known = levels[-1].select("fp", F.lit(0).cast("long").alias("up")).distinct().select("fp", "up", zero.alias("entry"), zero.alias("leave"))
    for level in reversed(levels):
        folded = level.select("fp", "c", "m", up).join(known, ["fp", "up"]).groupBy("fp", "up").applyInPandas(opened, "fp long, c long, entry int, leave int")
        known = folded.withColumnRenamed("c", "up")
    return known.withColumnRenamed("up", "c")


def _giants(texts: DataFrame, path: str) -> DataFrame:
    """fp and ids of each different giant text."""
    reach = Pieces.of(path).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text read once and cut into chunks, each with a look ahead."""
        for batch in batches:
            for fp, text in zip(batch["fp"].to_pylist(), batch["text"].to_pylist(), strict=True):
                body = " " + text
                starts = list(range(0, len(body), CHUNK))
                columns = [[fp] * len(starts), list(range(len(starts))), [body[i : i + CHUNK + reach] for i in starts], [min(CHUNK, len(body) - i) for i in starts]]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fp", "c", "part", "n"])

    cuts = texts.groupBy("fp").agg(F.min("text").alias("text")).mapInArrow(cut, "fp long, c long, part string, n long")
    chunks = stage(cuts.repartition("fp", "c"), "scan-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            rows = [pieces.matrix(t, n).tobytes() for t, n in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["fp"], batch["c"], pa.array(rows, pa.binary())], names=["fp", "c", "m"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            parts = (batch[c].to_pylist() for c in ("part", "n", "entry", "leave"))
            rows = [pieces.trace(t, n, a, b) for t, n, a, b in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["fp"], batch["c"], pa.array(rows, pa.binary())], names=["fp", "c", "ids"])

    scored = stage(chunks.mapInArrow(matrices, "fp long, c long, m binary"), "scan-matrices")
    bounds = _bounds(scored, reach, 1 + (scored.agg(F.max("c").alias("c")).first()["c"] or 0))
    ids = chunks.join(bounds, ["fp", "c"]).select("fp", "c", "part", "n", "entry", "leave").mapInArrow(trace, "fp long, c long, ids binary")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: F.hex(x["ids"]))
    return ids.groupBy("fp").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def encode(docs: DataFrame, path: str, giant: int = GIANT) -> DataFrame:
    """One row per document: doc_id, text, ids (packed little-endian, four bytes each)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            ids = [pieces.encode(t) if t else b"" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    short = texts.where(F.length("text") < giant).mapInArrow(whole, "doc_id long, text string, ids binary")
    long = texts.where(F.length("text") >= giant).withColumn("fp", F.xxhash64("text"))
    return short.unionByName(long.join(_giants(long.select("fp", "text"), path), "fp").select("doc_id", "text", "ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encode``'s rows with the text decoded from the ids, as column decoded."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            texts = pa.array([pieces.decode(i) for i in batch["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "text", "ids")), texts], names=["doc_id", "text", "ids", "decoded"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(back, "doc_id long, text string, ids binary, decoded string")
