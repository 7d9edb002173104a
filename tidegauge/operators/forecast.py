"""The published forecast: one row for each series and horizon, nested as the artifact nests it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published quantiles and the exceedance grid's 101 moves.
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
MOVES = [round(-0.25 + 0.005 * i, 3) for i in range(101)]


def _share(paths: str, hit) -> Column:
    return F.size(F.filter(paths, hit)) / F.size(paths)


def forecast_blocks(paths: DataFrame, by: list[str], adverse: float = 0.1) -> DataFrame:
    """quantiles, exceedance and adverse-move blocks from (key, anchor, prices) rows.

    The grid is read off arrays of reduced paths, whose length is the number of paths."""
    red = paths.select(*by, "anchor", F.struct(F.element_at("prices", -1).alias("t"), F.array_min("prices").alias("lo"), F.array_max("prices").alias("hi")).alias("r"))
    packed = red.groupBy(*by, "anchor").agg(F.collect_list("r").alias("rs"), F.percentile("r.t", F.array(*map(F.lit, QUANTILES))).alias("q"))
    level = lambda m: F.col("anchor") * (1 + m)

    def cell(m: Column) -> Column:
        touch = F.when(m < 0, _share("rs", lambda r: r["lo"] <= level(m))).otherwise(_share("rs", lambda r: r["hi"] >= level(m)))
        return F.struct(m.alias("move"), _share("rs", lambda r: r["t"] >= level(m)).alias("terminal"), touch.alias("touch"))

    quantiles = F.struct(*[F.col("q")[i].alias(f"q{int(p * 100):02d}") for i, p in enumerate(QUANTILES)])
    down = F.struct(
        F.lit(adverse).alias("move"), _share("rs", lambda r: r["lo"] <= level(-adverse)).alias("touch"), _share("rs", lambda r: r["t"] <= level(-adverse)).alias("terminal")
    )
    grid = F.transform(F.array(*map(F.lit, MOVES)), cell)
    return packed.select(*by, "anchor", quantiles.alias("quantiles"), grid.alias("exceedance"), down.alias("adverse_move"), F.size("rs").alias("n_paths"))


def as_json(blocks: DataFrame, by: list[str], schema_version: int = 4) -> DataFrame:
    """(key, artifact): one JSON document for each forecast."""
    body = F.struct(F.lit(schema_version).alias("schema_version"), *[F.col(c) for c in blocks.columns])
    return blocks.select(*by, F.to_json(body).alias("artifact"))
