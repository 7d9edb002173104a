"""Best-fit packing by exact-complement hashing.

Tokenising writes one row per piece, with the piece's rank among those of its length in its task.
Piece lengths run from 1 to the capacity, so the packing itself works on counts by length, a
table of at most ``capacity`` rows whatever the input: longest first, each gap is filled exactly
by one, two or three available lengths, looked up by their total in indexes of single, pair and
triple sums that are kept under the counts, consuming as many of the combination as the counts
allow at once; what finds no exact complement is placed best-fit. The plan is a list of intervals of ranks by length, bounded in the same way;
pieces look up their place in it by global rank. Nothing is dropped or capped.

Defined cases: null text is empty (its document is the end token alone); repeated rows are packed
each on its own; an empty table gives an empty result; only id and text columns are read.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, stage

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, k long"
PIECES_KEPT = 400_000
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Pieces(dict):
    """Ids of a plain word's pieces, as bytes; what was used since the last but one overflow is remembered."""

    def __init__(self, new: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.new, self.most, self.older = new, most, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        self[piece] = ids = self.new(piece) if ids is None else ids
        return ids


class WordEncoder:
    """Token ids as packed little-endian bytes; pieces of words are encoded once and remembered up to a bound.

    Exact for tokenizers whose tokens never span white space: splitting there then never changes
    the ids. Lines of ASCII and Latin-1 letters are cut into letters, digits and marks here, as the
    tokenizer would, and only new pieces go to its merge table; other lines go word by word, and
    a word of other characters through the tokenizer as a whole.
    """

    PLAIN = re.compile("[ \\t\\r!-~À-ÖØ-öø-ÿ]*")
    CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \\t\\ra-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.words = Pieces(self._merged, PIECES_KEPT), Pieces(self._whole, PIECES_KEPT // 4)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        probe = "Ab3's \u00c9t\u00e9, x--y!? it'll 'd\u00df9-'tis\ta\r  b"
        self.cuts = self._cut(probe) == self._whole(probe)

    def _merged(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.letters) if not piece.isascii() else piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.CUT.findall(text.lower())))

    def _plain(self, text: str) -> bool:
        return self.cuts and "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            out = []
            for line in text.split("\n"):
                if self._plain(line):
                    out.append(self._cut(line))
                else:
                    out += [self._cut(w) if self._plain(w) else self.words[w] for w in line.split(" ") if w]
            yield b"".join(out)


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, encoder = TaskContext.get().partitionId(), Counter(), WordEncoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for row, ids in enumerate(encoder.encode(["" if t is None else t for t in batch["text"].to_pylist()])):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((row, piece, start, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            row, piece, start, length, crc, tasks, k = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 7))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length, pa.int32()),
                    pa.array(crc),
                    pa.array(tasks, pa.int32()),
                    pa.array(k),
                ],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )
        encoder = rows = batch = None
        give_back()

    return cut


class Sums:
    """Indexes of single, pair and triple sums: by total, the available lengths that add up to it.

    An entry is a combination's longest length, or for triples one length whose remainder the index
    of pairs has. Counts only fall, so an entry that has run out is passed for good and the index
    moves on to the total's next combination; none is looked at twice."""

    def __init__(self, left: list[int]) -> None:
        self.left = left
        self.pair = [total - 1 for total in range(len(left))]
        self.triple = [total - 2 for total in range(len(left))]

    def one(self, total: int) -> Iterator[tuple[int, ...]]:
        if total > 0 and self.left[total]:
            yield (total,)

    def _is_pair(self, high: int, low: int) -> bool:
        return self.left[high] > (high == low) and self.left[low] > 0

    def two(self, total: int) -> Iterator[tuple[int, ...]]:
        """Available pairs, longest member first; the index keeps the first one."""
        if total < 2:
            return
        high = self.pair[total]
        while 2 * high >= total and not self._is_pair(high, total - high):
            high -= 1
        self.pair[total] = high
        for high in range(high, (total - 1) // 2, -1):
            if self._is_pair(high, total - high):
                yield high, total - high

    def three(self, total: int) -> Iterator[tuple[int, ...]]:
        if total < 3:
            return
        third = self.triple[total]
        while third > 0 and not (self.left[third] and next(self.two(total - third), None)):
            third -= 1
        self.triple[total] = third
        for third in range(third, 0, -1):
            if self.left[third]:
                for parts in self.two(total - third):
                    yield third, *parts


def plan_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Fill sequences by lengths: (lengths in one sequence, how many such sequences)."""
    left = [counts.get(length, 0) for length in range(capacity + 1)]
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        patterns.append(((capacity,), left[capacity]))
        left[capacity] = 0

    def fits(parts: tuple[int, ...]) -> int:
        return min(left[p] // n for p, n in Counter(parts).items())

    sums = Sums(left)

    def exact(length: int, gap: int) -> tuple[int, ...] | None:
        return next((found for c in (sums.one, sums.two, sums.three) for parts in c(gap) if fits(found := (length, *parts))), None)

    rest: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := exact(length, capacity - length)):
            n = fits(found)
            patterns.append((found, n))
            for part in found:
                left[part] -= n
        if left[length]:
            rest.append((length, left[length]))
            left[length] = 0
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, parts: tuple[int, ...], n: int) -> None:
        if gap == 0:
            patterns.append((parts, n))
            return
        if not open_[gap]:
            bisect.insort(gaps, gap)
        open_[gap].append((parts, n))

    for length, n in rest:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            gap = gaps[at]
            parts, m = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            most = gap // length
            full = min(m, n // most) if n >= most else 0
            if full:
                put(gap - most * length, parts + (length,) * most, full)
                n -= full * most
            else:
                put(gap - n * length, parts + (length,) * n, 1)
                n, full = 0, 1
            if m > full:
                put(gap, parts, m - full)
    for entries in open_.values():
        patterns += entries
    return patterns


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of the intervals, the first one's sequence, the offset in it."""
    rows, used, base = defaultdict(list), Counter(), 0
    for parts, n in patterns:
        offset = 0
        for length in parts:
            rows[length].append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def _placed(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                firsts, bases, offsets = places[int(length)]
                i = np.searchsorted(firsts, ranks[at], "right") - 1
                sequence[at], offset[at] = bases[i] + ranks[at] - firsts[i], offsets[i]
            same = [batch[c] for c in ("doc_id", "piece", "start")]
            rest = [pa.array(lengths.astype(np.int64)), batch["ids_crc32"], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(same + rest, names=[c.split()[0] for c in PLACED.split(", ")])

    return place


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(texts.mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "pack-pieces")
    by_task = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_counts(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # as many rows as tasks times lengths: never broadcast
    ranked = pieces.join(first.hint("merge"), ["task", "length"]).withColumn("rank", F.col("first") + F.col("k"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(places), PLACED)
