"""Sources and sinks (scans, normalisers, exports, store, dimensions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PRICE, PRIORITY, WIND, registry, results, rounded, sql, summary_sql
from tidegrid.functions.time import hour_no, hour_ts, to_local
from tidegrid.operators.align import pick_source, zone_sources
from tidegrid.operators.screen import price_screen
from tidegrid.operators.trading import backtest_summary
from tidegrid.session import staging_path
from tidegrid.sources import dims, exports, records, store
from tidegrid.sources import market_events as market

QUERIES, SQL, query = registry()


# ------------------------------------------------------------ stored series


@query(
    "a01_write_and_read_series",
    sql("SELECT source, zone, ts_utc, price_eur_mwh FROM ps WHERE source = 'energinet'", "ps"),
)
def _(spark, d):
    root = staging_path(spark, "series")
    rows = market.prices_by_source(spark, d).withColumn(
        "price_dkk_mwh", F.lit(None).cast("double")
    )
    store.write_series(rows, root, "day_ahead_prices")
    back = store.read_series(spark, root, "day_ahead_prices", source="energinet")
    return back.select("source", "zone", "ts_utc", PRICE)


@query(
    "a02_overwrite_touched_months",
    sql("SELECT source, zone, ts_utc, price_eur_mwh + 1 AS price_eur_mwh FROM ps", "ps"),
)
def _(spark, d):
    root = staging_path(spark, "series")
    rows = market.prices_by_source(spark, d).withColumn(
        "price_dkk_mwh", F.lit(None).cast("double")
    )
    store.write_series(rows, root, "day_ahead_prices")
    store.write_series(rows.withColumn(PRICE, F.col(PRICE) + 1), root, "day_ahead_prices")
    return store.read_series(spark, root, "day_ahead_prices").select(
        "source", "zone", "ts_utc", PRICE
    )


@query(
    "a03_merge_series",
    sql(
        """SELECT zone, ts_utc, coalesce(n.price_eur_mwh, o.price_eur_mwh) AS price_eur_mwh
FROM (SELECT * FROM ps WHERE source = 'energinet') o
FULL JOIN (SELECT * FROM ps WHERE source = 'entsoe') n USING (zone, ts_utc)""",
        "ps",
    ),
)
def _(spark, d):
    rows = market.prices_by_source(spark, d)
    old = rows.where(F.col("source") == "energinet").drop("source")
    new = rows.where(F.col("source") == "entsoe").drop("source")
    return store.merge_series(old, new, ["zone", "ts_utc"])


@query(
    "a03_merge_into_store",
    sql(
        """SELECT 'merged' AS source, zone, ts_utc,
       coalesce(n.price_eur_mwh, o.price_eur_mwh) AS price_eur_mwh
FROM (SELECT * FROM ps WHERE source = 'energinet') o
FULL JOIN (SELECT * FROM ps WHERE source = 'entsoe') n USING (zone, ts_utc)""",
        "ps",
    ),
)
def _(spark, d):
    root = staging_path(spark, "series")
    rows = market.prices_by_source(spark, d).withColumn(
        "price_dkk_mwh", F.lit(None).cast("double")
    )
    for s in PRIORITY:
        part = rows.where(F.col("source") == s).withColumn("source", F.lit("merged"))
        store.merge_into(part, root, "day_ahead_prices")
    return store.read_series(spark, root, "day_ahead_prices").select(
        "source", "zone", "ts_utc", PRICE
    )


@query(
    "a04_stored_range",
    sql('SELECT zone, min(ts_utc) AS start, max(ts_utc) AS "end" FROM p GROUP BY zone', "p"),
)
def _(spark, d):
    return store.coverage(market.prices(spark, d))


@query(
    "a05_catalogue",
    sql(
        """SELECT source, zone, 'prices' AS datatype, count(*) AS n_rows, min(ts_utc) AS start,
       max(ts_utc) AS "end" FROM ps GROUP BY source, zone
UNION ALL
SELECT source, zone, 'wind', count(*), min(ts_utc), max(ts_utc) FROM wsrc GROUP BY source, zone""",
        "ps wsrc",
    ),
)
def _(spark, d):
    return store.catalogue(
        {"prices": market.prices_by_source(spark, d), "wind": market.wind_by_source(spark, d)}
    )


def _upserted(spark, d) -> str:
    """A store that the hourly prices went into by two overlapping upserts."""
    root = staging_path(spark, "series")
    rows = market.prices_by_source(spark, d).withColumn("price_dkk_mwh", F.lit(None).cast("double"))
    for part in (rows.where("hour(ts_utc) < 16"), rows.where("hour(ts_utc) >= 8")):
        store.merge_into(part, root, "day_ahead_prices")
    return root


@query(
    "a04_range_from_summary",
    sql('SELECT zone, min(ts_utc) AS start, max(ts_utc) AS "end" FROM ps GROUP BY zone', "ps"),
)
def _(spark, d):
    return store.stored_coverage(spark, _upserted(spark, d), "day_ahead_prices")


@query(
    "a05_catalogue_from_summary",
    sql(
        """SELECT source, zone, 'day_ahead_prices' AS datatype, count(*) AS n_rows, min(ts_utc) AS start,
  max(ts_utc) AS "end" FROM ps GROUP BY source, zone""",
        "ps",
    ),
)
def _(spark, d):
    return store.stored_catalogue(spark, _upserted(spark, d), ["day_ahead_prices"])


@query(
    "a20_covers_from_summary",
    sql(
        """SELECT source, zone, min(ts_utc) AS start, max(ts_utc) AS "end",
  min(ts_utc) <= TIMESTAMP '2024-01-01 05:00:00' AND max(ts_utc) >= TIMESTAMP '2024-01-30 20:00:00' AS covered
FROM ps GROUP BY source, zone""",
        "ps",
    ),
)
def _(spark, d):
    return store.stored_covers(
        spark, _upserted(spark, d), "day_ahead_prices", "2024-01-01 05:00:00", "2024-01-30 21:00:00",
        ("source", "zone"),
    )


@query(
    "a21_missing_from_summary",
    sql(
        """SELECT z.source, z.zone, CAST(s AS DATE) AS chunk_start, CAST(s + INTERVAL 1 DAY AS DATE) AS chunk_end
FROM (SELECT DISTINCT source, zone FROM ps) z
CROSS JOIN generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) t(s)
WHERE NOT EXISTS (SELECT 1 FROM ps e WHERE e.zone = z.zone AND e.source = z.source
  AND e.ts_utc >= s AND e.ts_utc < s + INTERVAL 1 DAY)""",
        "ps",
    ),
)
def _(spark, d):
    return store.stored_missing_chunks(
        spark, _upserted(spark, d), "day_ahead_prices", "2023-12-30", "2024-02-03", "1 days",
        ("source", "zone"),
    )


@query(
    "a06_pick_source",
    sql(
        """SELECT ps.* FROM ps JOIN (
  SELECT zone, min(CASE source WHEN 'energinet' THEN 0 ELSE 1 END) AS best FROM ps GROUP BY zone) b
  ON ps.zone = b.zone AND b.best = CASE ps.source WHEN 'energinet' THEN 0 ELSE 1 END""",
        "ps",
    ),
)
def _(spark, d):
    return pick_source(market.prices_by_source(spark, d), PRIORITY)


_MARKET_ZONES = ", ".join(f"('{z[0]}')" for z in dims.ZONES)


@query(
    "a07_zone_sources",
    sql(
        f"""SELECT z.zone, coalesce(min(ps.source), 'none') AS source
FROM (SELECT * FROM (VALUES {_MARKET_ZONES}) m(zone) UNION ALL SELECT zone FROM dim) z
LEFT JOIN ps ON ps.zone = z.zone GROUP BY z.zone""",
        "ps dim",
    ),
)
def _(spark, d):
    known = dims.zones(spark).select("zone").union(market.zone_dim(spark).select("zone"))
    return zone_sources(market.prices_by_source(spark, d), known, PRIORITY)


# ----------------------------------------------------------- landed payloads


def _payloads(rows, fields):
    """One landed document per zone and UTC day: its records as JSON."""
    record = F.struct(
        F.date_format(F.col("ts_utc"), "yyyy-MM-dd'T'HH:mm:ss").alias("HourUTC"),
        F.col("zone").alias("PriceArea"),
        *[F.col(c).alias(f) for f, c in fields.items()],
    )
    return (
        rows.groupBy("zone", F.col("ts_utc").cast("date").alias("day"))
        .agg(F.collect_list(record).alias("records"))
        .select(F.to_json(F.struct("records")).alias("payload"))
    )


@query(
    "a08_normalise_spot",
    sql(
        """SELECT 'energinet' AS source, zone, ts_utc, price_eur_mwh,
       price_eur_mwh * 7.46e0 AS price_dkk_mwh FROM p""",
        "p",
    ),
)
def _(spark, d):
    rows = market.prices(spark, d).withColumn("dkk", F.col(PRICE) * 7.46)
    return records.normalise_spot(
        _payloads(rows, {"SpotPriceEUR": PRICE, "SpotPriceDKK": "dkk"})
    )


def _landed(spark, payloads, label: str) -> str:
    """A folder of JSON files holding the documents of a payload table."""
    path = staging_path(spark, label)
    payloads.select("payload").write.text(path)
    return path


@query(
    "a08_spot_from_landed_files",
    sql(
        """SELECT 'energinet' AS source, zone, ts_utc, price_eur_mwh,
       price_eur_mwh * 7.46e0 AS price_dkk_mwh FROM p""",
        "p",
    ),
)
def _(spark, d):
    rows = market.prices(spark, d).withColumn("dkk", F.col(PRICE) * 7.46)
    path = _landed(spark, _payloads(rows, {"SpotPriceEUR": PRICE, "SpotPriceDKK": "dkk"}), "spot-files")
    return records.normalise_spot(records.read_records(spark, path))


def _quarter_production(spark, d):
    """Quarter-hourly production records, as text payloads."""
    k, c = market.share_key(), market.cents("value")
    quarter = F.make_dt_interval(mins=(F.floor(F.minute("ts") / 15) * 15).cast("int"))
    rows = (
        market.events(spark, d)
        .groupBy("zone", (hour_ts(hour_no("ts")) + quarter).alias("ts_utc"))
        .agg(
            (F.sum(c) / 100.0 + 3000.0).alias("total"),
            (F.sum(F.when(k < 34, c)) / 10.0).alias("onshore"),
            (F.sum(F.when((k >= 34) & (k < 67), c)) / 10.0).alias("offshore"),
            (F.sum(F.when(k >= 67, c)) / 10.0).alias("solar"),
        )
    )
    return _payloads(
        rows,
        {
            "TotalLoad": "total",
            "OnshoreWindPower": "onshore",
            "OffshoreWindPower": "offshore",
            "SolarPower": "solar",
        },
    )


_PRODUCTION_SQL = """(SELECT zone, h AS ts_utc, avg(total) AS total_load_mw,
       avg(onshore) AS wind_onshore_mw, avg(offshore) AS wind_offshore_mw, avg(solar) AS solar_mw
FROM (SELECT zone, h, minute(ts) // 15 AS q, CAST(sum(c) AS BIGINT) / 100e0 + 3000e0 AS total,
        CAST(sum(c) FILTER (WHERE k < 34) AS BIGINT) / 10e0 AS onshore,
        CAST(sum(c) FILTER (WHERE k >= 34 AND k < 67) AS BIGINT) / 10e0 AS offshore,
        CAST(sum(c) FILTER (WHERE k >= 67) AS BIGINT) / 10e0 AS solar
      FROM ev GROUP BY ALL) GROUP BY zone, h)"""
_ABSENT = ("gas", "coal", "biomass", "waste", "hydro", "exchange_continent", "exchange_nordic",
           "exchange_great_belt")


@query(
    "a09_normalise_production",
    sql(
        "SELECT 'energinet' AS source, *, "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS {a}_mw" for a in _ABSENT)
        + f" FROM {_PRODUCTION_SQL}",
        "ev",
        "total_load_mw wind_onshore_mw wind_offshore_mw solar_mw",
    ),
)
def _(spark, d):
    return rounded(records.normalise_production(_quarter_production(spark, d)))


@query(
    "a10_wind_solar_from_production",
    sql(
        "SELECT 'energinet' AS source, zone, ts_utc, wind_onshore_mw, wind_offshore_mw, solar_mw "
        f"FROM {_PRODUCTION_SQL}",
        "ev",
        "wind_onshore_mw wind_offshore_mw solar_mw",
    ),
)
def _(spark, d):
    production = records.normalise_production(_quarter_production(spark, d))
    return rounded(records.wind_solar_of(production))


@query(
    "a10_load_from_production",
    sql(
        "SELECT 'energinet' AS source, zone, ts_utc, total_load_mw AS load_mw "
        f"FROM {_PRODUCTION_SQL}",
        "ev",
        "load_mw",
    ),
)
def _(spark, d):
    production = records.normalise_production(_quarter_production(spark, d))
    return rounded(records.load_of(production))


@query("a11_normalise_load", sql("SELECT 'entsoe' AS source, zone, ts_utc, load_mw FROM l", "l"))
def _(spark, d):
    landed = market.load(spark, d).select(
        "zone", "ts_utc", F.col("load_mw").cast("string").alias("Forecasted Load"),
        F.lit("0").alias("Actual Load"),
    )
    return records.normalise_transparency(landed, "load_forecast")


@query(
    "a12_normalise_wind_solar",
    sql(
        """SELECT 'entsoe' AS source, zone, ts_utc, wind_onshore_mw, 0e0 AS wind_offshore_mw,
       solar_mw FROM ws""",
        "ws",
    ),
)
def _(spark, d):
    landed = market.wind_solar(spark, d).select(
        "zone", "ts_utc", F.col("solar_mw").alias("Solar"),
        F.col("wind_onshore_mw").alias("Wind Onshore"),
    )
    return records.normalise_transparency(landed, "wind_solar_forecast")


@query(
    "a13_normalise_price",
    sql("SELECT 'entsoe' AS source, zone, ts_utc, price_eur_mwh FROM p", "p"),
)
def _(spark, d):
    landed = market.prices(spark, d).withColumnRenamed(PRICE, "0")
    return records.normalise_transparency(landed, "day_ahead_prices")


_FLOW_SQL = """(SELECT e.from_zone, e.to_zone, a.h AS ts_utc, (a.c - b.c) / 100e0 AS flow_mw
FROM edges e
JOIN (SELECT zone, h, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1, 2) a ON a.zone = e.from_zone
JOIN (SELECT zone, h, CAST(sum(c) AS BIGINT) AS c FROM ev GROUP BY 1, 2) b
  ON b.zone = e.to_zone AND b.h = a.h)"""


@query("a13_normalise_flow", sql(f"SELECT 'entsoe' AS source, * FROM {_FLOW_SQL}", "ev edges"))
def _(spark, d):
    landed = market.flows(spark, d).withColumnRenamed("flow_mw", "0")
    return records.normalise_transparency(landed, "flow")


@query(
    "a14_normalise_weather",
    sql(
        """SELECT zone, h AS ts_utc, CAST(sum(c) AS BIGINT) / 100e0 AS temperature_2m,
       CAST(min(c) AS DOUBLE) AS wind_speed_10m, CAST(max(c) AS DOUBLE) AS wind_speed_100m,
       CAST(sum(k) AS DOUBLE) AS direct_radiation, CAST(count(*) AS DOUBLE) AS diffuse_radiation
FROM ev GROUP BY zone, h""",
        "ev",
    ),
)
def _(spark, d):
    c = market.cents("value")
    hourly = (
        market.events(spark, d)
        .groupBy("zone", hour_ts(hour_no("ts")).alias("ts_utc"))
        .agg(
            (F.sum(c) / 100.0).alias("temperature_2m"),
            F.min(c).alias("wind_speed_10m"),
            F.max(c).alias("wind_speed_100m"),
            F.sum(market.share_key()).alias("direct_radiation"),
            F.count(F.lit(1)).alias("diffuse_radiation"),
        )
    )
    names = [c for c in hourly.columns if c not in ("zone", "ts_utc")]
    local = to_local("ts_utc", records.WEATHER_TZ)
    listed = (
        hourly.groupBy("zone", local.cast("date").alias("day"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.date_format(local, "yyyy-MM-dd'T'HH:mm").alias("time"), *names)
                )
            ).alias("r")
        )
    )
    document = F.struct(F.struct(*[F.col(f"r.{n}").alias(n) for n in ("time", *names)]).alias("hourly"))
    payloads = listed.select("zone", F.to_json(document).alias("payload"))
    return records.normalise_weather(payloads)


# ------------------------------------------------------------- file exports

# event zone → area code, delimiter of its file
AREAS = (
    ("click", "DK1", ","),
    ("view", "SE3", ";"),
    ("purchase", "DE-LU", "\t"),
    ("signup", "NO2", ","),
    ("error", "SE4", ";"),
)
_AREA_SQL = """(VALUES ('click', 'DK1', 'DK_1'), ('view', 'SE3', 'SE_3'),
  ('purchase', 'DE-LU', 'DE_LU'), ('signup', 'NO2', 'NO_2'), ('error', 'SE4', 'SE_4'))
  area(event_zone, code, mapped)"""


def _export_lines(rows, prefix: str, headers: list[str], values: list[str], area_header=None):
    """Rows as text lines of one exported file per zone, header line first."""
    local = to_local("ts_utc")
    start = F.date_format(local, "dd.MM.yyyy HH:mm")
    stop = F.date_format(local + F.expr("INTERVAL 1 HOUR"), "dd.MM.yyyy HH:mm")
    area = F.create_map(*[F.lit(x) for z, code, _ in AREAS for x in (z, code)])
    mark = F.create_map(*[F.lit(x) for z, _, sep in AREAS for x in (z, sep)])
    code, sep = F.element_at(area, F.col("zone")), F.element_at(mark, F.col("zone"))

    def line(*cells):
        quoted = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in cells]
        out = quoted[0]
        for q in quoted[1:]:
            out = F.concat(out, sep, q)
        return out

    file = F.concat(F.lit(f"{prefix}_"), code, F.lit(".csv")).alias("file")
    span = F.concat(start, F.lit(" - "), stop)
    extra = [F.concat(F.lit("BZN|"), code)] if area_header else []
    data = rows.select(
        file, hour_no("ts_utc").alias("line_no"),
        line(span, *extra, *[F.col(v).cast("string") for v in values]).alias("value"),
    )
    names = ["MTU (CET/CEST)", *([area_header] if area_header else []), *headers]
    head = (
        rows.select("zone").distinct()
        .select(file, F.lit(-1).cast("bigint").alias("line_no"),
                line(*[F.lit(n) for n in names]).alias("value"))
    )
    return data.unionByName(head)


def _price_lines(spark, d):
    return _export_lines(
        market.prices(spark, d), "DayAheadPrices", ["Day-ahead Price [EUR/MWh]"], [PRICE], "Area"
    )


@query(
    "a15_split_export_lines",
    sql(
        f"""SELECT 'DayAheadPrices_' || code || '.csv' AS file, CAST(3 AS INTEGER) AS n_columns,
       count(*) AS n_lines FROM p JOIN {_AREA_SQL} ON event_zone = zone GROUP BY 1, 2""",
        "p",
    ),
)
def _(spark, d):
    lines = _price_lines(spark, d)
    return (
        exports.split_lines(lines, exports.file_facts(lines))
        .groupBy("file", F.size("cells").alias("n_columns"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query(
    "a16_detect_zone",
    sql(
        f"""SELECT 'DayAheadPrices_' || code || '.csv' AS file, mapped AS zone, count(*) AS n_lines
FROM p JOIN {_AREA_SQL} ON event_zone = zone GROUP BY 1, 2
UNION ALL
SELECT 'Load_' || code || '.csv', mapped, count(*)
FROM l JOIN {_AREA_SQL} ON event_zone = zone GROUP BY 1, 2""",
        "p l",
    ),
)
def _(spark, d):
    lines = _price_lines(spark, d).unionByName(
        _export_lines(market.load(spark, d), "Load", ["Day-ahead Total Load [MW]"], ["load_mw"])
    )
    return (
        exports.split_lines(lines, exports.file_facts(lines))
        .groupBy("file", exports.detect_zone().alias("zone"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query(
    "a17_detect_data_type",
    sql(
        """SELECT 'prices' AS data_type, count(*) AS n_lines FROM p
UNION ALL SELECT 'load', count(*) FROM l
UNION ALL SELECT 'generation', count(*) FROM ws""",
        "p l ws",
    ),
)
def _(spark, d):
    lines = (
        _price_lines(spark, d)
        .unionByName(
            _export_lines(market.load(spark, d), "Load", ["Total [MW]"], ["load_mw"])
        )
        .unionByName(
            _export_lines(
                market.wind_solar(spark, d), "Export", ["Wind Onshore [MW]", "Solar [MW]"],
                ["wind_onshore_mw", "solar_mw"],
            )
        )
    )
    return (
        exports.split_lines(lines, exports.file_facts(lines))
        .groupBy("data_type")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query(
    "a18_parse_export_time",
    sql(f"SELECT mapped AS zone, ts_utc FROM p JOIN {_AREA_SQL} ON event_zone = zone", "p"),
)
def _(spark, d):
    return exports.classified(_price_lines(spark, d), "Europe/Copenhagen").select("zone", "ts_utc")


@query(
    "a19_import_prices",
    sql(
        f"""SELECT 'entsoe' AS source, mapped AS zone, ts_utc, price_eur_mwh
FROM p JOIN {_AREA_SQL} ON event_zone = zone""",
        "p",
    ),
)
def _(spark, d):
    return exports.import_table(_price_lines(spark, d), "day_ahead_prices", "Europe/Copenhagen")


@query(
    "a19_import_generation",
    sql(
        f"""SELECT 'entsoe' AS source, mapped AS zone, ts_utc, wind_onshore_mw,
       wind_offshore_mw, solar_mw FROM ws JOIN {_AREA_SQL} ON event_zone = zone""",
        "ws",
    ),
)
def _(spark, d):
    lines = _export_lines(
        market.wind_solar(spark, d), "GenerationForecast",
        ["Generation - Wind Onshore [MW]", "Generation - Wind Offshore [MW]", "Solar [MW]"], WIND,
        "Area",
    )
    return exports.import_table(lines, "wind_solar_forecast", "Europe/Copenhagen")


@query(
    "a19_import_load",
    sql(
        f"""SELECT 'entsoe' AS source, mapped AS zone, ts_utc, load_mw
FROM l JOIN {_AREA_SQL} ON event_zone = zone""",
        "l",
    ),
)
def _(spark, d):
    lines = _export_lines(
        market.load(spark, d), "Load", ["Day-ahead Total Load Forecast [MW]"], ["load_mw"], "Area"
    )
    return exports.import_table(lines, "load_forecast", "Europe/Copenhagen")


@query(
    "a19_import_rejects",
    sql(
        f"""SELECT 'DayAheadPrices_' || code || '.csv' AS file,
  CASE WHEN k = 0 THEN 'unreadable time' ELSE 'unreadable value' END AS reason,
  count(*) AS n_lines
FROM (SELECT *, CAST(epoch(ts_utc) AS BIGINT) // 3600 % 5 AS k FROM p)
JOIN {_AREA_SQL} ON event_zone = zone WHERE k < 2 GROUP BY 1, 2""",
        "p",
    ),
)
def _(spark, d):
    turn = F.pmod("line_no", F.lit(5))
    broken = F.when(F.col("line_no") < 0, F.col("value")).when(
        turn == 0, F.regexp_replace("value", "[0-9][0-9]:[0-9][0-9]", "noon")
    ).when(turn == 1, F.regexp_replace("value", '"[^"]*"$', '"n/e"'))
    lines = _price_lines(spark, d)
    return exports.rejects(
        lines.withColumn("value", F.coalesce(broken, "value")), "Europe/Copenhagen"
    )


@query(
    "a19_import_flows",
    sql(
        f"""SELECT 'entsoe' AS source,
  CASE WHEN position(a.code IN 'NO2 SE3 SE4 DE-LU DK1') < position(b.code IN 'NO2 SE3 SE4 DE-LU DK1')
       THEN a.mapped ELSE b.mapped END AS from_zone,
  CASE WHEN position(a.code IN 'NO2 SE3 SE4 DE-LU DK1') < position(b.code IN 'NO2 SE3 SE4 DE-LU DK1')
       THEN b.mapped ELSE a.mapped END AS to_zone, ts_utc, flow_mw
FROM {_FLOW_SQL} f
JOIN {_AREA_SQL.replace(" area(", " a(")} ON a.event_zone = f.from_zone
JOIN {_AREA_SQL.replace(" area(", " b(")} ON b.event_zone = f.to_zone""",
        "ev edges",
    ),
)
def _(spark, d):
    area = F.create_map(*[F.lit(x) for z, code, _ in AREAS for x in (z, code)])
    local = to_local("ts_utc")
    rows = market.flows(spark, d).withColumn(
        "file",
        F.concat(
            F.lit("flow_"), F.element_at(area, F.col("from_zone")), F.lit("_"),
            F.element_at(area, F.col("to_zone")), F.lit(".csv"),
        ),
    )
    data = rows.select(
        "file", hour_no("ts_utc").alias("line_no"),
        F.concat_ws(
            ",", F.date_format(local, "dd.MM.yyyy HH:mm"), F.col("flow_mw").cast("string")
        ).alias("value"),
    )
    head = rows.select("file").distinct().select(
        "file", F.lit(-1).cast("bigint").alias("line_no"),
        F.lit("DateTime,Physical Flow [MW]").alias("value"),
    )
    return exports.import_table(data.unionByName(head), "flow", "Europe/Copenhagen")


# -------------------------------------------------------- coverage and sinks


@query(
    "a20_range_covered",
    sql(
        """SELECT zone, min(ts_utc) AS start, max(ts_utc) AS "end",
  min(ts_utc) <= TIMESTAMP '2024-01-01 01:00:00'
    AND max(ts_utc) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR AS covered
FROM (SELECT CAST(user_id AS VARCHAR) AS zone, h AS ts_utc FROM ev) GROUP BY zone""",
        "ev",
    ),
)
def _(spark, d):
    by_user = market.prices(spark, d, "user_id")
    return store.covers(by_user, "2024-01-01 01:00:00", "2024-01-31 00:00:00")


@query(
    "a21_missing_chunks",
    sql(
        """SELECT z.zone, CAST(s AS DATE) AS chunk_start,
       least(CAST(s + INTERVAL 3 DAY AS DATE), DATE '2024-02-15') AS chunk_end
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS zone FROM events) z
CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-14', INTERVAL 3 DAY) t(s)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE CAST(e.user_id AS VARCHAR) = z.zone
  AND e.ts >= s AND e.ts < s + INTERVAL 3 DAY)"""
    ),
)
def _(spark, d):
    by_user = market.prices(spark, d, "user_id")
    return store.missing_chunks(by_user, "2024-01-01", "2024-02-15", "3 days")


@query(
    "a21_missing_months",
    sql(
        """SELECT z.zone, CAST(s AS DATE) AS chunk_start,
       least(CAST(s + INTERVAL 3 MONTH AS DATE), DATE '2002-03-01') AS chunk_end
FROM (SELECT DISTINCT o_orderpriority AS zone FROM orders) z
CROSS JOIN generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2002-02-28', INTERVAL 3 MONTH) t(s)
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = z.zone
  AND o.o_orderdate >= s AND o.o_orderdate < s + INTERVAL 3 MONTH)"""
    ),
)
def _(spark, d):
    history = market.error_history(spark, d)
    return store.missing_chunks(history, "1992-01-01", "2002-03-01", "3 months")


_SCREEN_SQL = """(SELECT zone, count(*) AS n_hours,
  count(*) FILTER (WHERE price_eur_mwh < -500 OR price_eur_mwh > 3000) AS n_out_of_range,
  count(*) FILTER (WHERE price_eur_mwh < 0) AS n_negative FROM p GROUP BY zone)"""


@query(
    "a22_report_sinks",
    sql(
        f"SELECT f.fmt, s.* FROM (VALUES ('csv'), ('json'), ('parquet')) f(fmt) "
        f"CROSS JOIN {_SCREEN_SQL} s",
        "p",
    ),
)
def _(spark, d):
    report = price_screen(market.prices(spark, d)).drop("negative_pct")
    back = None
    for fmt in ("csv", "json", "parquet"):
        path = staging_path(spark, f"report-{fmt}")
        store.write_report(report, path, fmt)
        reader = spark.read.schema(report.schema).format(fmt)
        part = (reader.option("header", True) if fmt == "csv" else reader).load(path)
        part = part.withColumn("fmt", F.lit(fmt))
        back = part if back is None else back.unionByName(part)
    return back


@query(
    "a23_ok_summaries",
    sql(
        f"""SELECT zone, total_pnl AS backtest_pnl, sharpe_ratio AS sharpe, win_rate_pct AS win_pct,
       n_trades AS trades, n_trading_days AS n_test_days
FROM ({summary_sql('zone', 'res')}) WHERE total_pnl > 0""",
        "res",
        "backtest_pnl sharpe win_pct",
    ),
)
def _(spark, d):
    summary = backtest_summary(results(spark, d))
    status = F.when(F.col("total_pnl") > 0, "ok").otherwise("no_results")
    records_ = summary.withColumn("status", status).withColumnRenamed(
        "n_trading_days", "n_test_days"
    )
    return rounded(store.ok_summary(records_))


@query(
    "a23_summary_file",
    sql(
        f"""SELECT zone, total_pnl AS backtest_pnl, sharpe_ratio AS sharpe, win_rate_pct AS win_pct,
       n_trades AS trades, n_trading_days AS n_test_days
FROM ({summary_sql('zone', 'res')}) WHERE total_pnl > 0""",
        "res",
        "backtest_pnl sharpe win_pct",
    ),
)
def _(spark, d):
    summary = backtest_summary(results(spark, d)).withColumnRenamed("n_trading_days", "n_test_days")
    status = F.when(F.col("total_pnl") > 0, "ok").otherwise("no_results")
    path = staging_path(spark, "summary-file")
    listed = summary.withColumn("status", status).agg(  # one record per zone
        F.to_json(F.collect_list(F.struct("zone", "status", "total_pnl", "sharpe_ratio", "win_rate_pct",
                                          "n_trades", "n_test_days")))
    )
    listed.write.text(path)
    return rounded(store.read_summary(spark, path))


@query(
    "a24_zone_dimension",
    sql(
        """SELECT p.zone, label, entry_cost_eur, annual_cost, count(*) AS n_hours
FROM p LEFT JOIN dim USING (zone) GROUP BY ALL""",
        "p dim",
    ),
)
def _(spark, d):
    hours = market.prices(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("n_hours"))
    return hours.join(market.zone_dim(spark), "zone", "left")
