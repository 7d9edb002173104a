"""The series cache: Parquet beside a JSON sidecar, written atomically, merged by upsert."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

META = (
    "series_id string, source_name string, source_url string, citation struct<cite_as:string,licence:string,source_confidence:string,source_url:string>, "
    "fetched_at timestamp, rows bigint, start date, end date, has_ohlc boolean, fallbacks array<string>"
)
OHLC = {"open", "high", "low", "close"}


def merge_upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """Union of both; for a key the fresh row wins, and among its rows the last by ``seq``."""
    both = old.withColumn("_fresh", F.lit(0)).unionByName(new.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_fresh"), *([F.desc(seq)] if seq else [])]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n", "_fresh")


def keep_last(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row for each key: the last by ingest sequence."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


@dataclass
class Meta:
    """Provenance of a cached series."""

    series_id: str
    source_name: str
    source_url: str
    citation: dict
    rows: int
    start: str | None
    end: str | None
    has_ohlc: bool
    fetched_at: str = ""
    fallbacks: list[str] = field(default_factory=list)


def build_meta(df: DataFrame, series_id: str, source_name: str, source_url: str, citation: dict, fetched_at: str = "", fallbacks: tuple = ()) -> Meta:
    if citation.get("source_confidence") not in ("primary", "secondary"):
        raise ValueError("a citation states its confidence")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    return Meta(series_id, source_name, source_url, citation, got["n"], got["a"], got["b"], set(df.columns) >= OHLC, fetched_at, list(fallbacks))


class CacheStore:
    """Series under one root folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        path = self.hadoop.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, series_id: str) -> list[str]:
        """Folders of the series, the current one first; a plain file of that name stands for itself."""
        path, fs = self._path(f"{series_id}.current")
        if not fs.exists(path):
            plain = f"{series_id}.parquet"
            return [plain] if fs.exists(self._path(plain)[0]) else []
        return [r["value"] for r in self.spark.read.text(f"{self.root}/{series_id}.current", wholetext=True).collect()][0].split()

    def _swap(self, name: str, content: str) -> None:
        """Put a small file in one step: written beside, then renamed over what is there."""
        aside, fs = self._path(f".{name}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target, _ = self._path(name)
        self.hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, options)

    def has(self, series_id: str) -> bool:
        return bool(self._versions(series_id))

    def rows_only(self, series_id: str) -> DataFrame | None:
        """The rows, whatever the sidecar is like. All of them are read once, as damage to pages shows only
        then; what cannot be read is a miss."""
        versions = self._versions(series_id)
        if not versions:
            return None
        try:
            rows = self.spark.read.parquet(f"{self.root}/{versions[0]}")
            rows.write.format("noop").mode("overwrite").save()
            return rows
        except (PySparkException, Py4JJavaError):
            return None

    def meta(self, series_id: str) -> dict | None:
        """The sidecar; one without a citation is a miss."""
        path, fs = self._path(f"{series_id}.meta.json")
        if not fs.exists(path):
            return None
        got = self.spark.read.schema(META).json(f"{self.root}/{series_id}.meta.json", multiLine=True).where("citation IS NOT NULL").collect()
        return got[0].asDict(True) if got else None

    def read(self, series_id: str) -> tuple[DataFrame, dict] | None:
        rows, meta = self.rows_only(series_id), self.meta(series_id)
        return None if rows is None or meta is None else (rows, meta)

    def write(self, series_id: str, df: DataFrame, meta: Meta) -> None:
        """Write a new version, then swap the pointer to it: a reader sees the old series or the new one,
        and one that has begun on the old one can end, as one version back is kept."""
        version = f"{series_id}.{uuid.uuid4().hex}.parquet"
        df.write.parquet(f"{self.root}/{version}")
        older = self._versions(series_id)
        self._swap(f"{series_id}.current", "\n".join([version, *older[:1]]))
        self._swap(f"{series_id}.meta.json", json.dumps(asdict(meta), sort_keys=True, indent=1))
        for name in older[1:]:
            path, fs = self._path(name)
            fs.delete(path, True)

    def merge_write(self, series_id: str, df: DataFrame, meta: Meta) -> DataFrame:
        """Fresh rows win by date, the last of them that df lists; OHLC holds only if both sides carry it."""
        old = self.rows_only(series_id)
        listed = df.withColumn("_seq", F.monotonically_increasing_id())
        merged = keep_last(listed, ["date"], "_seq") if old is None else merge_upsert(old, listed, ["date"], "_seq")
        merged = merged.drop("_seq")
        merged = merged.orderBy("date")
        known = self.meta(series_id)
        full = build_meta(merged, series_id, meta.source_name, meta.source_url, meta.citation, meta.fetched_at, tuple(meta.fallbacks))
        full.has_ohlc = meta.has_ohlc and (known is None or bool(known["has_ohlc"]))
        self.write(series_id, merged, full)
        return self.spark.read.parquet(f"{self.root}/{self._versions(series_id)[0]}")
