"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components become integers, each a weighted term. Queries are taken in blocks of bounded bytes,
each broadcast in turn to where the candidates lie, so candidates are never moved or copied. A task
reads its candidates in groups; for a group every term's postings (the candidates with a weight
other than 0) are scattered, times the block's query weights, into a dense score array. The k best
of each array are selected by partition and merged into the task's lists; the tasks' lists of a
query are merged by a window over tasks x k rows. Every query meets every candidate, so the result
is exact.

Defined cases: vectors that are null or hold null or non-finite components take no part; absent
trailing components weigh 0; ties go to the smaller id; a query's own id is never its answer;
fewer than k candidates give shorter lists; a query row that repeats another's id and vector asks
once, rows of one id with different vectors share one list of that id's best answers; candidate
rows count each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

GROUP_ROWS = 2048
QUERIES_AT_ONCE = 256
BLOCK_BYTES = 32 << 20  # of a broadcast block of queries
OUT = "query_id long, vec_id long, score long"
NEVER = np.iinfo(np.int64).min


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, np.arange(len(flat)) - starts] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores by terms: each term adds its postings, weighted, to the rows that use the term."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        rows, posts = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        if len(rows) == len(queries) and len(posts) == len(candidates):
            scores += queries[:, term, None] * candidates[None, :, term]
        elif len(rows) and len(posts):
            scores[np.ix_(rows, posts)] += queries[rows, term, None] * candidates[None, posts, term]
    return scores


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, ties to the smaller id."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    head = np.r_[True, row[1:] != row[:-1]][: len(row)]
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
    return row[rank < k], ids[rank < k], scores[rank < k]


def _group(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Entries (row of the query, id, score) that hold each query's k best of a group of candidates."""
    order = np.argsort(ids, kind="stable")
    ids, candidates = ids[order], candidates[order]
    found = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        scores = accumulate(queries[at : at + QUERIES_AT_ONCE], candidates)
        asks = query_ids[at : at + QUERIES_AT_ONCE]
        low, high = np.searchsorted(ids, asks, "left"), np.searchsorted(ids, asks, "right")
        for i in np.flatnonzero(high > low):  # a query's own row
            scores[i, low[i] : high[i]] = NEVER
        bar = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(scores), NEVER)
        row, at_id = np.nonzero((scores >= bar[:, None]) & (scores > NEVER))
        found.append(_best(row + at, ids[at_id], scores[row, at_id], k))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _search(block: Broadcast, k: int, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        best = (np.zeros(0, np.int64),) * 3
        ids, rows, held = [], [], 0

        def settle() -> None:
            nonlocal best, ids, rows, held
            more = _group(query_ids, queries, np.concatenate(ids), np.concatenate(rows), k)
            best = _best(*(np.concatenate(c) for c in zip(best, more, strict=True)), k)
            ids, rows, held = [], [], 0

        for batch in batches:
            ids.append(batch["id"].to_numpy())
            rows.append(_matrix(batch["vec"], width))
            held += batch.num_rows
            if held >= GROUP_ROWS:
                settle()
        if held:
            settle()
        columns = [query_ids[best[0]], best[1], best[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = vectors.where(
        F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(vec_col, finite), F.lit(False))
    ).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    sizes = valid.agg(F.coalesce(F.count_if("asks"), F.lit(0)).alias("q"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    width = max(1, sizes["width"])
    blocks = max(1, -(-sizes["q"] * width * 8 // BLOCK_BYTES))
    queries = valid.where("asks").select("id", "vec").dropDuplicates(["id", "vec"])
    partial = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about BLOCK_BYTES
        block = spark.sparkContext.broadcast((rows["id"].to_numpy(), _matrix(rows["vec"], width)))
        found = valid.select("id", "vec").mapInArrow(_search(block, k, width), OUT)
        if blocks > 1:
            found = stage(found, "topk-block")
            block.destroy()
        partial = found if partial is None else partial.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
