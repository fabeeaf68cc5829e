"""Deduplication, grids, joins, reconciliation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import EVENT_ZONES, PRICE, PRIORITY, grid, registry, rounded, sql
from tidegrid.functions.time import hour_floor, local_date
from tidegrid.operators import align, profiles, screen
from tidegrid.sources import dims
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()


def _raw(spark, d):
    """Every event as one landed row of its hour, ingest order = event id."""
    return market.events(spark, d).select(
        "zone", hour_floor("ts").alias("ts_utc"), "value", "event_id"
    )


@query(
    "c01_dedup_keep_first",
    sql("SELECT zone, h AS ts_utc, arg_min(value, event_id) AS value FROM ev GROUP BY ALL", "ev"),
)
def _(spark, d):
    return align.dedup(_raw(spark, d), "event_id").drop("event_id")


@query(
    "c01_dedup_keep_last",
    sql("SELECT zone, h AS ts_utc, arg_max(value, event_id) AS value FROM ev GROUP BY ALL", "ev"),
)
def _(spark, d):
    return align.dedup(_raw(spark, d), "event_id", "last").drop("event_id")


_WHOLE = "wind_onshore_mw IS NOT NULL AND wind_offshore_mw IS NOT NULL AND solar_mw IS NOT NULL"


@query(
    "c02_align_to_reference",
    sql(
        f"""SELECT * FROM l SEMI JOIN (SELECT zone, ts_utc FROM ws WHERE {_WHOLE}) r
  USING (zone, ts_utc)""",
        "l ws",
    ),
)
def _(spark, d):
    ref = screen.complete_rows(market.wind_solar(spark, d))
    return align.align_to(market.load(spark, d), ref)


@query(
    "c03_left_align",
    sql(
        f"""SELECT p.*, w.solar_mw FROM p
LEFT JOIN (SELECT * FROM ws WHERE {_WHOLE}) w USING (zone, ts_utc)""",
        "p ws",
    ),
)
def _(spark, d):
    other = screen.complete_rows(market.wind_solar(spark, d)).select("zone", "ts_utc", "solar_mw")
    return align.left_align(market.prices(spark, d), other)


@query(
    "c04_inner_join_series",
    sql(
        f"""SELECT zone, ts_utc, price_eur_mwh, solar_mw, load_mw
FROM p JOIN (SELECT * FROM ws WHERE {_WHOLE}) USING (zone, ts_utc) JOIN l USING (zone, ts_utc)""",
        "p ws l",
    ),
)
def _(spark, d):
    wind = screen.complete_rows(market.wind_solar(spark, d)).select("zone", "ts_utc", "solar_mw")
    return align.inner_align(market.prices(spark, d), wind, market.load(spark, d))


@query("c05_hourly_grid", sql("SELECT * FROM g", "g"))
def _(spark, d):
    return grid(spark, d)


@query(
    "c05_resample_mean",
    sql(
        """SELECT hrs.zone, hrs.ts_utc, m.value FROM hrs
LEFT JOIN (SELECT zone, h AS ts_utc, avg(value) AS value FROM ev GROUP BY ALL) m
  USING (zone, ts_utc)""",
        "hrs",
        "value",
        places=9,
    ),
)
def _(spark, d):
    raw = market.events(spark, d).select("zone", F.col("ts").alias("ts_utc"), "value")
    return rounded(align.to_grid(raw, ["value"]), places=9)


@query(
    "c05_resample_first",
    sql(
        """SELECT hrs.zone, hrs.ts_utc, m.value FROM hrs
LEFT JOIN (SELECT zone, h AS ts_utc, arg_min(value, ts) AS value FROM ev GROUP BY ALL) m
  USING (zone, ts_utc)""",
        "hrs",
    ),
)
def _(spark, d):
    raw = market.events(spark, d).select("zone", F.col("ts").alias("ts_utc"), "value")
    return align.to_grid(raw, ["value"], agg="first")


@query("c06_gaps", sql("SELECT zone, ts_utc FROM g WHERE price_eur_mwh IS NULL", "g"))
def _(spark, d):
    return align.gaps(market.prices(spark, d))


@query(
    "c06_gap_intervals",
    sql(
        """SELECT zone, h + INTERVAL 1 HOUR AS start, n - INTERVAL 1 HOUR AS "end",
  date_diff('hour', h, n) - 1 AS n_hours
FROM (SELECT zone, ts_utc AS h, lead(ts_utc) OVER (PARTITION BY zone ORDER BY ts_utc) AS n FROM p)
WHERE n > h + INTERVAL 1 HOUR""",
        "p",
    ),
)
def _(spark, d):
    return align.gap_intervals(market.prices(spark, d))


_WIDE = """(SELECT zone, ts_utc, max(price_eur_mwh) FILTER (WHERE source = 'energinet') AS energinet,
  max(price_eur_mwh) FILTER (WHERE source = 'entsoe') AS entsoe FROM ps GROUP BY zone, ts_utc)"""


@query(
    "c07_compare_sources",
    sql(
        f"SELECT *, energinet - entsoe AS diff_energinet_entsoe FROM {_WIDE}",
        "ps",
        "diff_energinet_entsoe",
    ),
)
def _(spark, d):
    compared = align.compare_sources(market.prices_by_source(spark, d), PRICE, PRIORITY)
    return rounded(compared, "diff_energinet_entsoe")


@query(
    "c08_source_difference_stats",
    sql(
        f"""SELECT zone, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
  quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75,
  max(x) AS max, count(*) FILTER (WHERE abs(x) < 5) AS n_match,
  avg(CASE WHEN abs(x) < 5 THEN 1e0 ELSE 0e0 END) AS match_share
FROM (SELECT zone, energinet - entsoe AS x FROM {_WIDE}) WHERE x IS NOT NULL GROUP BY zone""",
        "ps",
        "mean std min p25 p50 p75 max match_share",
    ),
)
def _(spark, d):
    compared = align.compare_sources(market.prices_by_source(spark, d), PRICE, PRIORITY)
    return rounded(profiles.source_difference(compared, "diff_energinet_entsoe", 5.0))


_FILL = """(SELECT a.zone, a.ts_utc, coalesce(a.wind_onshore_mw, b.wind_onshore_mw) AS wind_onshore_mw,
  CASE WHEN a.wind_onshore_mw IS NOT NULL THEN 'energinet'
       WHEN b.wind_onshore_mw IS NOT NULL THEN 'entsoe' ELSE 'gap' END AS provenance
FROM (SELECT * FROM wsrc WHERE source = 'energinet') a
LEFT JOIN (SELECT * FROM wsrc WHERE source = 'entsoe') b USING (zone, ts_utc))"""


@query("c09_reconcile", sql(f"SELECT * FROM {_FILL}", "wsrc"))
def _(spark, d):
    rows = market.wind_by_source(spark, d)
    return align.reconcile(rows, "wind_onshore_mw", PRIORITY)[0]


@query(
    "c09_reconcile_extended",
    sql(
        """SELECT zone, ts_utc, coalesce(a.wind_onshore_mw, b.wind_onshore_mw) AS wind_onshore_mw,
  CASE WHEN a.wind_onshore_mw IS NOT NULL THEN 'energinet'
       WHEN b.wind_onshore_mw IS NOT NULL THEN 'entsoe' ELSE 'gap' END AS provenance
FROM (SELECT * FROM wsrc WHERE source = 'energinet') a
FULL JOIN (SELECT * FROM wsrc WHERE source = 'entsoe') b USING (zone, ts_utc)""",
        "wsrc",
    ),
)
def _(spark, d):
    rows = market.wind_by_source(spark, d)
    return align.reconcile(rows, "wind_onshore_mw", PRIORITY, extend=True)[0]


@query(
    "c09_reconcile_report",
    sql(
        f"""SELECT zone, 'energinet' AS primary_source, provenance, count(*) AS hours
FROM {_FILL} GROUP BY zone, provenance""",
        "wsrc",
    ),
)
def _(spark, d):
    rows = market.wind_by_source(spark, d)
    return align.reconcile(rows, "wind_onshore_mw", PRIORITY)[1]


def _repeated(rows, col):
    """Every row twice; the later one, larger by 1000, must not count."""
    later = rows.withColumn(col, F.col(col) + 1000).withColumn("ingested", F.lit(2))
    return rows.withColumn("ingested", F.lit(1)).unionByName(later)


@query("c09_reconcile_repeated_rows", sql(f"SELECT * FROM {_FILL}", "wsrc"))
def _(spark, d):
    rows = _repeated(market.wind_by_source(spark, d), "wind_onshore_mw")
    return align.reconcile(rows, "wind_onshore_mw", PRIORITY, order="ingested")[0]


@query(
    "c07_compare_repeated_rows",
    sql(
        f"SELECT *, energinet - entsoe AS diff_energinet_entsoe FROM {_WIDE}",
        "ps",
        "diff_energinet_entsoe",
    ),
)
def _(spark, d):
    rows = _repeated(market.prices_by_source(spark, d), PRICE)
    compared = align.compare_sources(rows, PRICE, PRIORITY, order="ingested")
    return rounded(compared, "diff_energinet_entsoe")


_PIVOT = ", ".join(f"max(price_eur_mwh) FILTER (WHERE zone = '{z}') AS {z}" for z in EVENT_ZONES)


@query("c10_price_matrix", sql(f"SELECT ts_utc, {_PIVOT} FROM p GROUP BY ts_utc", "p"))
def _(spark, d):
    return align.price_matrix(market.prices(spark, d), PRICE, EVENT_ZONES)


@query(
    "c10_price_matrix_repeated_rows", sql(f"SELECT ts_utc, {_PIVOT} FROM p GROUP BY ts_utc", "p")
)
def _(spark, d):
    rows = _repeated(market.prices(spark, d), PRICE)
    return align.price_matrix(rows, PRICE, EVENT_ZONES, order="ingested")


@query(
    "c10_matrix_nulls",
    sql(
        """SELECT zone, (SELECT count(DISTINCT ts_utc) FROM p) - count(*) AS n_missing
FROM p GROUP BY zone""",
        "p",
    ),
)
def _(spark, d):
    matrix = align.price_matrix(market.prices(spark, d), PRICE, EVENT_ZONES)
    return align.matrix_nulls(matrix, EVENT_ZONES)


@query(
    "c11_edge_prices",
    sql(
        """SELECT from_zone, to_zone, capacity_mw, a.ts_utc, a.price_eur_mwh AS price_from,
  b.price_eur_mwh AS price_to
FROM edges JOIN p a ON a.zone = from_zone JOIN p b ON b.zone = to_zone AND b.ts_utc = a.ts_utc""",
        "p edges",
    ),
)
def _(spark, d):
    return align.edge_prices(market.edges(spark), market.prices(spark, d))


@query(
    "c12_edge_labels",
    sql(
        """SELECT from_zone, to_zone, capacity_mw, a.label AS from_label, b.label AS to_label, n_hours
FROM edges LEFT JOIN dim a ON a.zone = from_zone LEFT JOIN dim b ON b.zone = to_zone
JOIN (SELECT zone, count(*) AS n_hours FROM p GROUP BY zone) h ON h.zone = from_zone""",
        "p edges dim",
    ),
)
def _(spark, d):
    hours = market.prices(spark, d).groupBy(F.col("zone").alias("from_zone")).agg(
        F.count(F.lit(1)).alias("n_hours")
    )
    labelled = align.edge_labels(market.edges(spark), market.zone_dim(spark))
    return labelled.join(hours, "from_zone")


# the 40-edge table, over events dealt to the real market zones
_MARKET = f"""mz(zone, label, capacity_mw) AS (SELECT * FROM (VALUES {
    ", ".join(f"('{z[0]}', '{z[1]}', 0)" for z in dims.ZONES)})),
links(from_zone, to_zone, capacity_mw) AS (SELECT * FROM (VALUES {
    ", ".join(f"('{a}', '{b}', {c})" for a, b, c in dims.INTERCONNECTORS)})),
mp AS (
  SELECT [{", ".join(f"'{z[0]}'" for z in dims.ZONES)}][k % {len(dims.ZONES)} + 1] AS zone, h AS ts_utc,
         CAST(sum(c) AS BIGINT) / (count(*) * 100e0) - 25e0 AS price_eur_mwh
  FROM ev GROUP BY ALL)"""


def _market_sql(body: str, r: str = "") -> str:
    text = sql("", "ev") + f",\n{_MARKET}\n{body}"
    swaps = ", ".join(f"round({c}, 9) + 0 AS {c}" for c in r.split())
    return f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)" if r else text


@query(
    "c11_interconnector_prices",
    _market_sql(
        """SELECT from_zone, to_zone, e.capacity_mw, a.ts_utc, a.price_eur_mwh AS price_from,
  b.price_eur_mwh AS price_to
FROM links e JOIN mp a ON a.zone = from_zone JOIN mp b ON b.zone = to_zone AND b.ts_utc = a.ts_utc"""
    ),
)
def _(spark, d):
    return align.edge_prices(dims.interconnectors(spark), market.prices(spark, d, market.market_zones()))


@query(
    "c12_interconnector_labels",
    _market_sql(
        """SELECT from_zone, to_zone, e.capacity_mw, a.label AS from_label, b.label AS to_label,
  count(p.ts_utc) AS n_hours
FROM links e LEFT JOIN mz a ON a.zone = from_zone LEFT JOIN mz b ON b.zone = to_zone
LEFT JOIN mp p ON p.zone = from_zone GROUP BY ALL"""
    ),
)
def _(spark, d):
    prices = market.prices(spark, d, market.market_zones())
    hours = prices.groupBy(F.col("zone").alias("from_zone")).agg(F.count("ts_utc").alias("n_hours"))
    labelled = align.edge_labels(dims.interconnectors(spark), dims.zones(spark))
    return labelled.join(hours, "from_zone", "left").na.fill(0, ["n_hours"])


@query(
    "f09_interconnector_spreads",
    _market_sql(
        """SELECT from_zone, to_zone, CAST(a.ts_utc + INTERVAL 1 HOUR AS DATE) AS day,
  avg(abs(a.price_eur_mwh - b.price_eur_mwh)) AS spread
FROM links e JOIN mp a ON a.zone = from_zone JOIN mp b ON b.zone = to_zone AND b.ts_utc = a.ts_utc
GROUP BY ALL""",
        "spread",
    ),
)
def _(spark, d):
    prices = market.prices(spark, d, market.market_zones())
    rows = align.edge_prices(dims.interconnectors(spark), prices)
    spread = rows.withColumn("spread", F.abs(F.col("price_from") - F.col("price_to")))
    days = spread.groupBy("from_zone", "to_zone", local_date("ts_utc").alias("day"))
    return rounded(days.agg(F.avg("spread").alias("spread")), places=9)


_DAYS = "(SELECT zone, CAST(ts_utc + INTERVAL 1 HOUR AS DATE) AS d, price_eur_mwh FROM p)"


@query(
    "c13_training_rows",
    sql(
        f"""SELECT f.zone, f.d AS fold_day, count(r.d) AS n_rows, avg(r.price_eur_mwh) AS mean_price
FROM (SELECT DISTINCT zone, d, min(d) OVER (PARTITION BY zone) AS first FROM {_DAYS}) f
JOIN {_DAYS} r ON r.zone = f.zone AND r.d < f.d AND r.d >= f.d - 7
WHERE f.d >= f.first + 7 GROUP BY f.zone, f.d""",
        "p",
        "mean_price",
    ),
)
def _(spark, d):
    rows = market.prices(spark, d).withColumn("local_date", local_date("ts_utc"))
    member = align.training_rows(rows, "local_date", 7)
    return rounded(
        member.groupBy("zone", "fold_day").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg(PRICE).alias("mean_price")
        )
    )


# ------------------------------------------------------------ set operations


@query(
    "j01_concat",
    sql(
        """SELECT zone, ts_utc, price_eur_mwh, CAST(NULL AS DOUBLE) AS load_mw FROM p
UNION ALL SELECT zone, ts_utc, NULL, load_mw FROM l""",
        "p l",
    ),
)
def _(spark, d):
    return align.concat(market.prices(spark, d), market.load(spark, d))


_WS_KEYS = f"(SELECT zone, ts_utc FROM ws WHERE {_WHOLE})"


@query(
    "j02_key_intersection",
    sql(f"SELECT zone, ts_utc FROM p INTERSECT SELECT zone, ts_utc FROM {_WS_KEYS}", "p ws"),
)
def _(spark, d):
    ref = screen.complete_rows(market.wind_solar(spark, d))
    return align.align_to(market.prices(spark, d), ref).select("zone", "ts_utc")


@query(
    "j03_key_difference",
    sql(f"SELECT zone, ts_utc FROM p EXCEPT SELECT zone, ts_utc FROM {_WS_KEYS}", "p ws"),
)
def _(spark, d):
    ref = screen.complete_rows(market.wind_solar(spark, d))
    return align.key_difference(market.prices(spark, d).select("zone", "ts_utc"), ref)


@query(
    "j04_overlap_exclusion",
    sql(
        """SELECT zone, ts_utc, price_eur_mwh FROM ps o WHERE source = 'energinet'
  AND NOT EXISTS (SELECT 1 FROM ps n WHERE n.source = 'entsoe' AND n.zone = o.zone
                  AND n.ts_utc = o.ts_utc)""",
        "ps",
    ),
)
def _(spark, d):
    rows = market.prices_by_source(spark, d)
    old = rows.where(F.col("source") == "energinet").drop("source")
    return align.key_difference(old, rows.where(F.col("source") == "entsoe"))
