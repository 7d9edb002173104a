"""Exact dedup by a heavy-hitter split; DataFrame operations only.

``freqItems`` is Spark's Misra-Gries summary (Karp, Shenker and Papadimitriou's form of it): at
most 1/support counters, and no digest more frequent than support x rows is missed. Its
candidates are counted exactly, the verified winners are broadcast (at most 1/support rows, a
bound that does not depend on the input), and rows that carry a winner are settled map-side,
without a shuffle. The other digests, each rarer than the support, take an ordinary shuffle.

Defined cases: null text counts as empty; only A-Z fold; the largest id of a group stays (a null
id loses to any other; a group of null ids keeps them all); a row repeated with the winning id
is kept each time, and of rows that share an id but not the text each is judged with its own
text; very long texts travel as digests only; an empty table gives an empty result; further input
columns are ignored, and ``keep_one`` passes them through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, stage

SUPPORT = 1e-3


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(F.col(text_col)), 256).alias("text_sha256")),
        "dedup-digests",
    )
    candidates = digests.stat.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    sums = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = stage(
        digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(*sums),
        "dedup-winners",
    )
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    light = light.join(light.groupBy("text_sha256").agg(*sums), "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents that stay, all columns unchanged."""
    key, digest = fresh(docs, "kept_id"), fresh(docs, "kept_sha256")
    kept = exact_dedup(docs, support=support).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.sha2(ascii_lower(docs["text"]), 256) == F.col(digest))
    return docs.join(kept, same, "left_semi")
