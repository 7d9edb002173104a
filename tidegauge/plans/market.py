"""Friction, routes, records, freshness, readers, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import record, trade
from ..sources import derived, readers
from ..sources.derived import BARS_SQL
from ..streaming import bars as streams
from . import ensembles
from .ensembles import PATHS_SQL
from .registry import query
from .series import rounded

#: id, kind, premium, tax, buyback, spread, expense, roll.
FRICTION = [
    ("retail", "physical", 0.03, 0.03, 0.03, 0.0, 0.0, 0.0), ("coin", "physical", 0.03, 0.0, 0.02, 0.0, 0.0, 0.0), ("bar", "physical", 0.015, 0.0, 0.01, 0.0, 0.0, 0.0),
    ("bond", "physical", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("fund", "roll", 0.0, 0.0, 0.0, 0.0005, 0.01, 0.005), ("cfd", "roll", 0.0, 0.0, 0.0, 0.0002, 0.0, 0.0715),
]
HORIZONS = [5, 21, 63, 252]
F_SQL = "fr AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {})".format(*r[:2], ", ".join(f"{x!r}::DOUBLE" for x in r[2:])) for r in FRICTION) + ") t(id, kind, premium, tax, buyback, spread, expense, roll))"
BE_SQL = f"""{F_SQL}, be AS (SELECT id, kind, h AS horizon, CASE WHEN kind = 'physical' THEN (1 + premium) * (1 + tax) / (1 - buyback)
    ELSE (1 + spread) * (1 + (expense + roll) * h / 365) / (1 - spread) END AS multiple FROM fr, (VALUES {", ".join(f"({h})" for h in HORIZONS)}) t(h))"""


def frictions(spark: SparkSession) -> DataFrame:
    return trade.breakeven(spark.createDataFrame(FRICTION, "id string, kind string, premium double, tax double, buyback double, spread double, expense double, roll double"), HORIZONS)


@query(f"WITH {BE_SQL} SELECT id, horizon, round(multiple, 10) AS multiple FROM be")
def friction_breakeven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frictions(spark).select("id", "horizon", "multiple"), 10)


@query(f"WITH {BE_SQL}, p AS (SELECT id, horizon, round((multiple - 1) * 100, 2) AS pct FROM be) SELECT id, " + ", ".join(f"max(pct) FILTER (WHERE horizon = {h}) AS h{h}" for h in HORIZONS) + " FROM p GROUP BY 1")
def breakeven_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.breakeven_pivot(frictions(spark), HORIZONS)


@query(f"WITH {BE_SQL} SELECT DISTINCT id, round(multiple, 10) AS multiple, CASE WHEN kind <> 'physical' THEN horizon END AS horizon FROM be")
def hurdle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trade.hurdle_events(frictions(spark)), 10)


def the_book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A route book from nations, regions and parts, with some planted breaches."""
    nation, region = derived.table(spark, sf_dir, "nation"), derived.table(spark, sf_dir, "region")
    code = F.upper(F.substring("n_name", 1, 3))
    code = F.when(F.col("n_nationkey") == 3, "c4").otherwise(F.concat(F.substring(code, 1, 2), F.expr("char(65 + cast(n_nationkey as int))")))
    j = nation.select(code.alias("code"), F.col("n_name").alias("label"), F.when(F.col("n_regionkey") < 2, F.concat(F.lit("B"), F.col("n_regionkey"))).alias("bloc"))
    b = j.where("bloc IS NOT NULL AND code <> 'c4'").groupBy("bloc").agg(F.array_sort(F.collect_list("code")).alias("members"))
    codes = j.agg(F.array_sort(F.collect_list("code")).alias("codes"))
    r = region.join(codes, F.lit(True)).select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("route"), F.slice("codes", F.col("r_regionkey") + 1, 6).alias("available_in"))
    t = r.select("route", F.explode("available_in").alias("code")).where("NOT (route = 'r2' AND code LIKE 'A%')")
    t = t.select("route", "code", F.when(F.col("route") == "r1", 1.0).otherwise(F.lit(None)).alias("leverage"), F.when(F.col("route") == "r3", 0.01).otherwise(0.0).alias("spread"), F.lit(None).cast("string").alias("spread_basis"))
    return j, b, r, t


BOOK_SQL = """j AS (SELECT CASE WHEN n_nationkey = 3 THEN 'c4' ELSE upper(substr(n_name, 1, 2)) || chr(65 + CAST(n_nationkey AS INTEGER)) END AS code, CASE WHEN n_regionkey < 2 THEN 'B' || n_regionkey END AS bloc FROM nation),
    b AS (SELECT bloc, list_sort(list(code)) AS members FROM j WHERE bloc IS NOT NULL AND code <> 'c4' GROUP BY 1), m AS (SELECT bloc, unnest(members) AS code FROM b),
    r AS (SELECT 'r' || r_regionkey AS route, list_slice((SELECT list_sort(list(code)) FROM j), r_regionkey + 1, r_regionkey + 6) AS available_in FROM region),
    o AS (SELECT route, unnest(available_in) AS code FROM r), t AS (SELECT route, code FROM o WHERE NOT (route = 'r2' AND code LIKE 'A%'))"""


@query(f"""WITH {BOOK_SQL} SELECT 'code_shape' AS rule, code AS subject FROM j WHERE NOT regexp_full_match(code, '[A-Z]{{3}}')
    UNION ALL SELECT 'member_not_listed', code FROM j WHERE bloc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.bloc = j.bloc AND m.code = j.code)
    UNION ALL SELECT 'cell_without_terms', o.route || '/' || o.code FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.route = o.route AND t.code = o.code)
    UNION ALL SELECT 'leverage', route || '/' || code FROM t WHERE route = 'r1' UNION ALL SELECT 'spread_without_basis', route || '/' || code FROM t WHERE route = 'r3'""")
def route_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.violations(*the_book(spark, sf_dir))


@query(f"WITH {BOOK_SQL} SELECT r.route, j.code FROM r, j WHERE NOT list_contains(r.available_in, j.code)")
def restricted_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, _, r, _ = the_book(spark, sf_dir)
    return trade.restricted_in(j, r)


@query(f"""WITH {PATHS_SQL}, g AS (SELECT series_id, pos, model, move, avg(CASE WHEN terminal >= anchor * (1 + move) THEN 1.0 ELSE 0 END) AS p FROM red, {ensembles.GRID_SQL} GROUP BY 1, 2, 3, 4),
    s AS (SELECT *, lead(move) OVER w AS x1, lead(p) OVER w AS p1 FROM g WINDOW w AS (PARTITION BY series_id, pos, model ORDER BY move))
    SELECT series_id, pos, model, round(p + (0.0937 - move) / (x1 - move) * (p1 - p), 7) AS p FROM s WHERE move <= 0.0937 AND x1 > 0.0937""")
def exceedance_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On every as-of date."""
    red = ensembles.paths.reduced(ensembles.ensemble(spark, sf_dir)).withColumn("move", F.explode(F.array(*map(F.lit, ensembles.GRID))))
    grid = red.groupBy(*ensembles.KEY, "move").agg(F.avg((F.col("terminal") >= F.col("anchor") * (1 + F.col("move"))).cast("double")).alias("p"))
    return rounded(trade.interpolate(grid, ensembles.KEY, 0.0937), 7)


# freshness and records

RUN = dt.date(2001, 8, 4)
POLICY = [("F", 4, True), ("O", 2000, True), ("P", None, True), ("never", 5, True), ("spare", 5, False)]


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = derived.bars(spark, sf_dir).groupBy("series_id").agg(F.max("date").alias("last_date")).withColumn("resolved", F.lit(True))
    return record.freshness(last, spark.createDataFrame(POLICY, "series_id string, max_lag int, blocking boolean"), RUN)


V_SQL = f"""{BARS_SQL}, pol AS (SELECT * FROM (VALUES {", ".join(f"('{i}', CAST({'NULL' if m is None else m} AS INTEGER), {str(b).lower()})" for i, m, b in POLICY)}) t(series_id, max_lag, blocking)),
    la AS (SELECT series_id, max(date) AS last_date FROM bars GROUP BY 1),
    ve AS (SELECT coalesce(p.series_id, l.series_id) AS series_id, coalesce(blocking, false) AS blocking, last_date, date_diff('day', last_date, DATE '{RUN}') AS lag_days,
           CASE WHEN l.series_id IS NULL THEN 'unavailable' WHEN max_lag IS NULL THEN 'undeclared' WHEN date_diff('day', last_date, DATE '{RUN}') > max_lag THEN 'stale' ELSE 'fresh' END AS verdict
           FROM pol p FULL JOIN la l ON l.series_id = p.series_id)"""


@query(f"WITH {V_SQL} SELECT * FROM ve")
def freshness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


@query(f"WITH {V_SQL} SELECT verdict, count(*) AS n, string_agg(series_id, ', ' ORDER BY series_id) AS series FROM ve WHERE blocking AND verdict <> 'fresh' GROUP BY 1")
def publish_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.refusal(verdicts(spark, sf_dir))


@query(f"""WITH {BARS_SQL}, x AS (SELECT DISTINCT date FROM bars)
    SELECT date, h AS horizon, CAST(date + CAST(h // 5 * 7 + h % 5 AS INTEGER) AS DATE) AS elapses, DATE '{RUN}' >= date + CAST(h // 5 * 7 + h % 5 AS INTEGER) AS frozen FROM x, (VALUES (5), (21), (63)) t(h)""")
def forecast_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = derived.bars(spark, sf_dir).select("date").distinct().withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(21), F.lit(63))))
    state = record.status(F.col("date"), F.col("horizon"), F.lit(True), RUN)
    return x.select("date", "horizon", record.earliest_elapse(F.col("date"), F.col("horizon")).alias("elapses"), (state == "frozen").alias("frozen"))


@query(f"""WITH {BARS_SQL}, pub AS (SELECT DISTINCT date FROM bars WHERE series_id = 'P'), sk AS (SELECT DISTINCT date, 'stale' AS reason FROM bars WHERE series_id = 'F' AND day(date) = 13),
    d AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM pub), (SELECT max(date) FROM pub), INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT d.date, sk.reason FROM d LEFT JOIN sk ON sk.date = d.date WHERE isodow(d.date) < 6 AND d.date NOT IN (SELECT date FROM pub)""")
def forecast_index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.bars(spark, sf_dir)
    skips = b.where("series_id = 'F' AND day(date) = 13").select("date", F.lit("stale").alias("reason")).distinct()
    return record.gaps(b.where("series_id = 'P'").select("date"), skips, F.min("date"), F.max("date"))


QP = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"""WITH {PATHS_SQL}, {ensembles.REAL_SQL}, q AS (SELECT series_id, pos, {", ".join(f"quantile_cont(terminal, {p}) AS q{i}" for i, p in enumerate(QP))} FROM red WHERE model = 1 GROUP BY 1, 2),
    x AS (SELECT q.*, t.y FROM q JOIN truth t ON t.series_id = q.series_id AND t.pos = q.pos)
    SELECT series_id, pos, round(CASE {" ".join(f"WHEN y BETWEEN q{i} AND q{i + 1} THEN {QP[i]} + (y - q{i}) / (q{i + 1} - q{i}) * {QP[i + 1] - QP[i]!r}" for i in range(4))} END, 6) AS pit, y < q0 OR y > q4 AS censored FROM x""")
def live_pit_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = ensembles.paths.reduced(ensembles.ensemble(spark, sf_dir).where("model = 1"))
    q = red.groupBy("series_id", "pos").agg(F.percentile("terminal", F.array(*map(F.lit, QP))).alias("q")).join(ensembles.truth(spark, sf_dir).select("series_id", "pos", "y"), ["series_id", "pos"])
    return q.select("series_id", "pos", F.round(record.interpolated_pit(F.col("q"), QP, F.col("y")), 6).alias("pit"), ((F.col("y") < F.col("q")[0]) | (F.col("y") > F.col("q")[4])).alias("censored"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT series_id, date, px, row_number() OVER (PARTITION BY series_id ORDER BY date) AS pos FROM bars),
    an AS (SELECT DISTINCT series_id, CAST(date + 3 AS DATE) AS date FROM bars WHERE day(date) = 1), pl AS (SELECT an.series_id, an.date, s.pos FROM an ASOF JOIN s ON s.series_id = an.series_id AND an.date >= s.date)
    SELECT pl.series_id, pl.date, s.date AS scored_on, round(s.px, 6) AS px FROM pl JOIN s ON s.series_id = pl.series_id AND s.pos = pl.pos + 21""")
def live_sessions_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.bars(spark, sf_dir).select("series_id", "date", "px")
    anchors = b.where("day(date) = 1").select("series_id", F.date_add("date", 3).alias("date")).distinct()
    return rounded(record.sessions_ahead(b, ["series_id"], anchors, 21), 6)


@query(f"""WITH RECURSIVE {BARS_SQL}, w AS (SELECT DISTINCT series_id, date FROM bars),
    g AS (SELECT series_id, min(date) AS date FROM w GROUP BY 1
          UNION ALL SELECT g.series_id, (SELECT min(w.date) FROM w WHERE w.series_id = g.series_id AND w.date >= g.date + 29) FROM g WHERE g.date IS NOT NULL)
    SELECT series_id, count(date) AS kept FROM g GROUP BY 1""")
def live_thinned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.bars(spark, sf_dir).groupBy("series_id").agg(F.collect_set("date").alias("days"))
    return b.select("series_id", record.thinned_count(F.col("days"), 21).alias("kept"))


@query("""WITH e AS (SELECT event_type, count(*) % 3 AS a, max(user_id) % 2 AS b FROM events GROUP BY 1) SELECT a, b, string_agg(event_type, ', ' ORDER BY event_type) AS labels FROM e GROUP BY 1, 2""")
def identical_event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.table(spark, sf_dir, "events").groupBy("event_type").agg((F.count(F.lit(1)) % 3).alias("a"), (F.max("user_id") % 2).alias("b"))
    return e.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ", ").alias("labels"))


# readers

REPORTS = [
    (1, "Daily Report  Date: 3rd June 1998\nGold 999 31,250 31,400\nDated Rates\n2nd June 1998 31300 5100\n1st June 1998 31,210 5090\nSPDR Gold 1,008.73 -0.57\nGold London PM Fix($/oz) 293.85"),
    (2, "Daily Report  Date: 4th June 1998\nGold 999 31500 31,600\nDated Rates\n3rd June 1998 31999 5100\n2nd June 1998 31305 5101\n29th May 1998 31,000 5000"),
    (3, "a page with none of it"),
]


def reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPORTS, "report_id long, text string")


REPORT_SQL = "rp AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in REPORTS) + ") t(report_id, text))"
_day = "CAST(try_strptime(regexp_replace(nullif({0}, ''), '^(\\d{{1,2}})(st|nd|rd|th)', '\\1'), '%d %B %Y') AS DATE)"
_num = "try_cast(replace(nullif(regexp_extract(text, '{0}', {1}), ''), ',', '') AS DOUBLE)"
_rep = {n: (r.replace("'", "''"), group) for n, (r, group) in readers.REPORT.items()}


@query(f"WITH {REPORT_SQL} SELECT CAST(report_id AS BIGINT) AS report_id, " + _day.format(f"regexp_extract(text, '{_rep['report_date'][0]}', 1)") + " AS report_date, " + ", ".join(_num.format(*_rep[n]) + f" AS {n}" for n in list(_rep)[1:]) + " FROM rp")
def report_regex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.report_fields(reports(spark))


_SERIES = [(dt.date(1998, 5, 29), 31000.0), (dt.date(1998, 6, 1), 31210.0), (dt.date(1998, 6, 2), 31305.0), (dt.date(1998, 6, 3), 31400.0), (dt.date(1998, 6, 4), 31600.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', {v}::DOUBLE)" for d, v in _SERIES) + ") t(date, value)")
def report_walk_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.report_series(reports(spark))


@query("""WITH j AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey, o_totalprice FROM orders), k AS (SELECT d, max(o_orderkey) AS o_orderkey FROM j WHERE o_orderkey % 7 <> 0 GROUP BY 1)
    SELECT j.d AS date, j.o_totalprice / 2 AS value FROM k JOIN j ON j.d = k.d AND j.o_orderkey = k.o_orderkey""")
def fix_list_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("d"), "o_totalprice")
    v = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.col("o_totalprice"))).otherwise(F.array(F.col("o_totalprice"), F.col("o_totalprice") / 2))
    entries = o.select("o_orderkey", F.struct("d", v.alias("v")).alias("x"))
    day = entries.groupBy(F.col("x.d").alias("d")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))), lambda e: e["x"])).alias("body"))
    return readers.fix_list(day, "body", 1)


@query("""SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS rows FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1""")
def risk_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders")
    sheet = o.select(
        F.date_format("o_orderdate", "yyyyMMdd").cast("long").alias("DAY"), F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("GPRD"), F.lit("x").alias("var_name")
    )
    return readers.risk_sheet(sheet, {"GPRD": "risk"}).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, arg_min(value, struct_pack(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling_bars(derived.table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n, max(value) AS high FROM s GROUP BY user_id, k""")
def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.session_bursts(derived.table(spark, sf_dir, "events"))
