"""Substring dedup by super-k-mer partitioning.

A window is 13 consecutive words; its minimiser is the least hash among its runs of three words.
Consecutive windows sharing a minimiser travel as one packed string (a super-k-mer) to the
minimiser's bucket, so equal windows always meet, and the words of a window are sent about three
times instead of thirteen. In the bucket the windows are sorted by hash and compared byte by byte,
so the result is exact: hashes only route and order. Windows that are alone in their cell of a table
of hashes have no equal and are not sorted.

Hot passages: each task first settles the windows of its own batch. A window that a smaller
document of the batch also has is removed there and then; only the windows of the batch's
smallest document travel.

Hot runs: a run of three words that would fill a bucket by itself, found in a sample of the rows,
is a minimiser only where a window has no other, so that windows which share no more than a common
phrase or line spread out. The sample decides where windows meet, never which are equal.

So a bucket gets a window at most once for each batch (and once for
each repeat inside that document), however many copies the corpus holds. The numbers of buckets and
of partitions follow the input's size, a partition's rows come sorted by bucket, and a task holds
one bucket at a time.

Defined cases: null text has no words; documents under 13 words lose nothing; a repeat inside
one document alone is no reason to remove; rows that repeat a document's id are compared by id,
so neither is smaller; a row without an id is left whole and makes no other lose words; very long
texts are a batch of their own; an empty table gives an empty result; only the id and text columns
are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, input_bytes, partition_count, small_batches

WINDOW = 13
MINIMISER = 3
BATCH_BYTES = 12 << 20
BUCKET_BYTES, PARTITION_BYTES = 4 << 20, 16 << 20
SAMPLE_BYTES, SAMPLE_SHARE = 8 << 20, 0.001  # of the input, to find hot runs
STRING_BYTES = 120  # of a super-k-mer, about
HOT_BITS, MOST_HOT = 22, 200_000
PARTS = "bucket int, doc_id long, fp long, data binary"
PARTS_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("data", pa.binary())])
KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)
SPACE = 0x20
STRIDE = 4096
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words from the words' hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(FACTOR) + h[i : i + len(out)]
    return _mix(out)


class Powers:
    """Powers of an odd number modulo 2^64, from two short tables."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.low = np.array([pow(base, i, 1 << 64) for i in range(STRIDE)], np.uint64)
        self.high = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        """The powers of base^STRIDE that numbers under n need."""
        need = n // STRIDE + 1
        if len(self.high) < need:
            self.high = np.array([pow(self.base, STRIDE * i, 1 << 64) for i in range(2 * need)], np.uint64)
        return self.high

    def at(self, places: np.ndarray) -> np.ndarray:
        high = self.upto(int(places[-1]) if len(places) else 0)
        return self.low[places % STRIDE] * high[places // STRIDE]


UP, DOWN = Powers(FACTOR), Powers(INVERSE)


class Words:
    """The words of a text parted by single spaces: where they lie, and hashes of runs of them.

    A prefix sum of byte x factor^place gives any run's hash by one difference, scaled back to
    place 0, so equal runs have equal hashes wherever they stand."""

    def __init__(self, raw: bytes) -> None:
        data = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(data == SPACE)
        self.starts = np.concatenate([[0], gaps + 1])
        self.ends = np.concatenate([gaps, [len(data)]])
        rows = -(-len(data) // STRIDE)
        terms = np.zeros((rows, STRIDE), np.uint64)
        terms.reshape(-1)[: len(data)] = data
        terms += np.uint64(1)
        terms *= UP.low
        terms *= UP.upto(len(data))[:rows, None]
        sums = np.concatenate([np.zeros(1, np.uint64), terms.reshape(-1)])
        np.cumsum(sums, out=sums)
        self.before, self.after, self.back = sums[self.starts], sums[self.ends], DOWN.at(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, n: int) -> np.ndarray:
        """Hash of each run of n words."""
        m = max(0, len(self) - n + 1)
        return _mix((self.after[n - 1 : n - 1 + m] - self.before[:m]) * self.back[:m])

    def minimisers(self, hot: np.ndarray | None = None) -> np.ndarray:
        """The least hash among each window's runs of MINIMISER words; those in cells of hot come last."""
        low, width, runs = self.runs(MINIMISER), 1, WINDOW - MINIMISER + 1
        if hot is not None:
            low = (low >> np.uint64(1)) | (hot[low >> np.uint64(64 - HOT_BITS)].astype(np.uint64) << np.uint64(63))
        while 2 * width <= runs:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        return np.minimum(low[: len(low) - runs + width], low[runs - width :])


def losers(key: np.ndarray, doc: np.ndarray, word: np.ndarray, begin: np.ndarray, end: np.ndarray, raw: bytes) -> np.ndarray:
    """For windows by hash, document's id, first word's number and place in raw: whether a smaller
    document has the same window. Exact: what has equal hashes is compared byte by byte."""
    lose = np.zeros(len(key), bool)
    if not len(key):
        return lose
    cell = key >> np.uint64(64 - max(8, int(len(key)).bit_length() + 2))
    last = np.zeros(int(cell.max()) + 1, np.int32)
    last[cell] = np.arange(len(cell), dtype=np.int32)
    many = np.zeros(len(last), bool)
    many[cell[last[cell] != np.arange(len(cell), dtype=np.int32)]] = True
    pick = np.flatnonzero(many[cell])
    order = pick[np.lexsort((doc[pick], key[pick]))]
    k = key[order]
    head = np.ones(len(order), bool)
    head[1:] = k[1:] != k[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
    later = doc[order] > doc[lead]
    mine, lead = order[later], lead[later]
    if not len(mine):
        return lose
    lose[mine] = True
    # passages that follow each other in both places are compared as one
    by = np.argsort(word[mine], kind="stable")
    mine, lead = mine[by], lead[by]
    cut = np.flatnonzero((np.diff(word[mine]) != 1) | (np.diff(word[lead]) != 1))
    first, final = np.r_[0, cut + 1], np.r_[cut, len(mine) - 1]
    places = (begin[mine[first]], end[mine[final]], begin[lead[first]], end[lead[final]])
    unlike = [n for n, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in places), strict=True)) if raw[a:b] != raw[c:d]]
    bad = np.unique(np.concatenate([key[mine[first[n] : final[n] + 1]] for n in unlike])) if unlike else ()
    for one in bad:  # two windows with one hash: settle that hash's windows by their words
        least: dict[bytes, int] = {}
        for i in order[k == one].tolist():
            lose[i] = doc[i] > least.setdefault(raw[begin[i] : end[i]], doc[i])
    return lose


def _verdicts(doc: np.ndarray, fp: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Lost windows as one row for each document: its ranges of words, merged."""
    order = np.lexsort((start, fp, doc))
    doc, fp, start = doc[order], fp[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
    cut = new.copy()
    cut[1:] |= np.diff(start) > WINDOW
    at = np.flatnonzero(cut)
    ranges = np.stack([start[at], start[np.r_[at[1:] - 1, len(start) - 1] if len(at) else at] + WINDOW], 1).astype("<i4")
    owner = np.flatnonzero(new)
    offsets = (8 * np.searchsorted(at, np.r_[owner, len(start)])).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ranges.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), -1, np.int32)), pa.array(doc[owner]), pa.array(fp[owner]), data], schema=PARTS_ARROW)


def _batch(docs: list[tuple[int, int, int, bytes]], buckets: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Settle the repeats of a batch (id, fp, number of words, words) and pack the rest by bucket."""
    docs.sort(key=lambda d: d[:2])
    ids, fps, sizes = (np.array([d[i] for d in docs], np.int64) for i in range(3))
    raw = b" ".join([d[3] for d in docs])
    words = Words(raw)
    row = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    begins = np.cumsum(sizes) - sizes
    at = np.flatnonzero(row[: 1 - WINDOW] == row[WINDOW - 1 :])
    lose = losers(words.runs(WINDOW)[at], ids[row[at]], at, words.starts[at], words.ends[at + WINDOW - 1], raw)
    lost, go = at[lose], at[~lose]
    if len(lost):
        r = row[lost]
        yield _verdicts(ids[r], fps[r], lost - begins[r])
    if not len(go):
        return
    least = words.minimisers(hot)[go]
    new = np.ones(len(go), bool)
    new[1:] = (np.diff(go) != 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    a, b = go[first], go[np.r_[first[1:] - 1, len(go) - 1]] + WINDOW
    bucket = (_mix(least[first] + np.uint64(77)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, a, b = bucket[order], a[order], b[order]
    strings = [raw[i:j] for i, j in zip(words.starts[a].tolist(), words.ends[b - 1].tolist(), strict=True)]
    r = row[a]
    start, size = (a - begins[r]).astype("<i4"), (b - a).astype("<i4")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)].tolist()
    squeeze = zstandard.ZstdCompressor(level=3)
    blocks = []
    for i, j in zip(cuts, cuts[1:]):
        mine = r[i:j]  # ascending: so are the ids
        next_doc = np.r_[True, mine[1:] != mine[:-1]]
        who = mine[next_doc]
        head = np.array([len(who), j - i], np.int64).tobytes() + np.diff(ids[who], prepend=0).tobytes() + fps[who].tobytes()
        blocks.append(squeeze.compress(b"".join((head, next_doc.tobytes(), start[i:j].tobytes(), size[i:j].tobytes(), b" ".join(strings[i:j])))))
    nothing = pa.nulls(len(blocks), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), nothing, nothing, pa.array(blocks, pa.binary())], schema=PARTS_ARROW)


def _sampled_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b" ".join(t.split()) for t in batch["text"].to_pylist()]
        runs, counts = np.unique(Words(b" ".join(texts)).runs(MINIMISER), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(counts.astype(np.int64))], names=["run", "n"])


def hot_runs(texts: DataFrame, size: int | None) -> np.ndarray | None:
    """Cells of the hashes of runs that would fill a bucket by themselves, judged by a sample of the rows."""
    if not size:
        return None
    share = min(1.0, (SAMPLE_BYTES + SAMPLE_SHARE * size) / size)
    least = max(8.0, share * BUCKET_BYTES / STRING_BYTES)
    runs = texts.sample(share, 5).select("text").mapInArrow(_sampled_runs, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    found = runs.where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(MOST_HOT).collect()
    hot = np.zeros(1 << HOT_BITS, bool)
    hot[np.array([r["run"] for r in found], np.int64).view(np.uint64) >> np.uint64(64 - HOT_BITS)] = True
    return hot if found else None


def _spread(buckets: int, hot: np.ndarray | None):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = [], 0
        for batch in batches:
            for doc_id, fp, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "fp", "text")), strict=True):
                words = text.split()
                if len(words) >= WINDOW:
                    joined = b" ".join(words)
                    docs.append((doc_id, fp, len(words), joined))
                    held += len(joined)
                if held >= BATCH_BYTES:
                    yield from _batch(docs, buckets, hot)
                    docs, held = [], 0
        if docs:
            yield from _batch(docs, buckets, hot)

    return spread


def _judge(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One bucket: sort its windows, and return the ranges that smaller documents also have."""
    texts, parts, n_words, n_bytes = [], [], 0, 0
    for block in blocks:
        packed = zstandard.ZstdDecompressor().decompress(block)
        n_docs, n = np.frombuffer(packed, np.int64, 2).tolist()
        ids, fps = np.cumsum(np.frombuffer(packed, np.int64, n_docs, 16)), np.frombuffer(packed, np.int64, n_docs, 16 + 8 * n_docs)
        at = 16 + 16 * n_docs
        who = np.cumsum(np.frombuffer(packed, bool, n, at)) - 1
        start, size = np.frombuffer(packed, "<i4", n, at + n), np.frombuffer(packed, "<i4", n, at + 5 * n)
        text = packed[at + 9 * n :]
        words = Words(text)
        # each string's windows: the words that start one, by their number in the block
        many = size - (WINDOW - 1)
        string = np.repeat(np.arange(n), many)
        place = np.arange(len(string)) - np.repeat(np.cumsum(many) - many, many)
        word = (np.cumsum(size) - size)[string] + place
        owner = who[string]
        parts.append((
            words.runs(WINDOW)[word], ids[owner], fps[owner], start[string] + place,
            n_words + word, n_bytes + words.starts[word], n_bytes + words.ends[word + WINDOW - 1],
        ))
        texts.append(text)
        n_words += len(words) + 1
        n_bytes += len(text) + 1
    key, doc, fp, start, word, begin, end = (np.concatenate(c) for c in zip(*parts, strict=True))
    lose = losers(key, doc, word, begin, end, b" ".join(texts))
    if lose.any():
        yield _verdicts(doc[lose], fp[lose], start[lose])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass settled ranges on; gather the blocks of one bucket after the other and judge them."""
    now, blocks = -1, []
    for batch in batches:
        settled = batch.filter(pa.compute.less(batch["bucket"], 0))
        if settled.num_rows:
            yield settled
        for bucket, block in zip(batch["bucket"].to_pylist(), batch["data"], strict=True):
            if bucket < 0:
                continue
            if bucket != now and blocks:
                yield from _judge(blocks)
                blocks = []
            now = bucket
            blocks.append(block.as_py())
    if blocks:
        yield from _judge(blocks)


def _kept(with_text: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lost in zip(batch["text"].to_pylist(), batch["lost"].to_pylist(), strict=True):
                words, removed = (text or b"").split(), 0
                n = len(words)
                if lost:
                    ranges = np.frombuffer(b"".join(lost), "<i4").reshape(-1, 2)
                    gone = np.bincount(ranges[:, 0], minlength=n + 1) - np.bincount(ranges[:, 1], minlength=n + 1)
                    stay = np.cumsum(gone)[:-1] == 0
                    removed = n - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                left = b" ".join(words)
                rows.append((n, removed, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(KEPT)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], schema=KEPT)

    return kept


def substring_dedup(docs: DataFrame, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (null without ``with_text``)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("fp", F.xxhash64("text"))
    texts_only = texts.where("doc_id is not null and text is not null")
    hot = hot_runs(texts_only, input_bytes(docs))
    parts = texts_only.mapInArrow(_spread(buckets or bucket_count(docs, BUCKET_BYTES), hot), PARTS)
    # a task's own verdicts pass through the buckets' shuffle in groups of their own
    settled = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).otherwise(F.col("bucket"))
    dealt = parts.withColumn("bucket", settled.cast("int"))
    dealt = dealt.repartition(partition_count(docs, PARTITION_BYTES), "bucket").sortWithinPartitions("bucket")
    ranges = dealt.mapInArrow(_by_bucket, PARTS)
    found = ranges.groupBy("doc_id", "fp").agg(F.collect_list("data").alias("lost"))
    return (
        texts.join(found, ["doc_id", "fp"], "left")
        .select("doc_id", "text", "lost")
        .mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
