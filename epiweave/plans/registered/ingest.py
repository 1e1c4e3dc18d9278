"""Cleaning, keep-last, upserts and the full refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.operators import aggregates, snapshot
from epiweave.plans import refresh, stored
from epiweave.plans.registered.snapshots import HOSP_COLUMNS
from epiweave.plans.registry import Sources, query, tidied, work_folder
from epiweave.schemas import TABLES
from epiweave.sources import landing, tables, testdata


@query(
    "dedup_last",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_shipdate DESC, l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) = 1""",
)
def _dedup_last(t):
    columns = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
    newest = [F.col(c).desc() for c in columns[2:]]
    return tables.keep_last(t.table("lineitem").select(*columns), columns[:2], *newest)


_HOSP_ALL = HOSP_COLUMNS + ", sex, race_ethnicity, rate_type"


@query(
    "upsert_hosp",
    f"""SELECT {_HOSP_ALL} FROM hosp QUALIFY row_number() OVER (
          PARTITION BY surveillance_network, week_ending_date, age_group, sex, race_ethnicity, site
          ORDER BY rate_type) = 1""",
    "hosp",
)
def _upsert_hosp(t):
    # 'Estimated' rows arrive as the batch and replace the stored 'Observed' ones.
    numbered = t.hosp.withColumn("_seq", F.lit(0).cast("long"))
    stored = numbered.filter(F.col("rate_type") == "Observed")
    batch = numbered.filter(F.col("rate_type") == "Estimated")
    key = TABLES["hospitalization_rates"].key
    return tables.merge_latest(stored, batch, key).drop("_seq")


@query(
    "upsert_ari",
    """SELECT week_end, geography, arg_max(label, rank) AS label, arg_max(buildnumber, rank) AS buildnumber FROM (
         SELECT week_end, geography, label, buildnumber, 0 AS rank FROM ari UNION ALL
         SELECT week_end + 7, geography, label, buildnumber, 1 FROM ari) GROUP BY 1, 2""",
    "ari",
)
def _upsert_ari(t):
    # The same rows a week later arrive as a batch: most keys are corrections, some are new.
    stored = t.ari.withColumn("_seq", F.lit(0).cast("long"))
    batch = stored.withColumn("week_end", F.date_add("week_end", 7))
    return tables.merge_latest(stored, batch, TABLES["ari_activity"].key).drop("_seq")


@query(
    "upsert_pos",
    """SELECT week_end, pathogen, round(max(percent_test_positivity), 8) + 0.0 AS percent_test_positivity FROM (
         SELECT week_end, pathogen, arg_max(percent_test_positivity, seq) AS percent_test_positivity FROM (
           SELECT CAST(ts AS DATE) AS week_end, CASE event_type WHEN 'click' THEN 'COVID-19' WHEN 'view' THEN
             'Influenza' WHEN 'purchase' THEN 'RSV' ELSE event_type END AS pathogen,
             value AS percent_test_positivity, event_id AS seq FROM events
           UNION ALL SELECT week_end, pathogen, percent_test_positivity, -1 FROM pos) GROUP BY 1, 2)
       GROUP BY 1, 2""",
    "pos",
)
def _upsert_pos(t):
    # The stored rows carry the lowest sequence number, every event is a later correction.
    stored = t.pos.withColumn("_seq", F.lit(-1).cast("long"))
    batch = raw_positivity(t.table("events"))
    cleaned = landing.accepted(landing.clean_positivity(batch))
    merged = tables.merge_latest(stored, cleaned, TABLES["test_positivity"].key, by_sequence=True)
    return tidied(merged.drop("_seq"), "percent_test_positivity")


def raw_positivity(events: DataFrame) -> DataFrame:
    """Events as raw text records of the positivity table."""
    return events.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00.000")).alias("week_end"),
        testdata.pathogen("event_type").alias("pathogen"),
        F.col("value").cast("string").alias("percent_test_positivity"),
        F.col("event_id").alias("_seq"),
    )


@query(
    "clean_numbers",
    """SELECT l_orderkey AS record, l_linenumber AS line, CAST(l_shipdate AS DATE) AS week_ending_date,
         CAST(CASE WHEN l_tax = 0 THEN NULL WHEN l_tax < CAST(0.03 AS DOUBLE) THEN 0 ELSE 27 END AS INTEGER) AS mmwr_week,
         CASE WHEN l_returnflag = 'A' THEN 'Overall' ELSE l_returnflag END AS age_group,
         CAST(CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS INTEGER) WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN NULL
              WHEN 5 THEN NULL WHEN 6 THEN 1000 ELSE 125 END AS DOUBLE) AS weekly_rate,
         CASE WHEN l_tax = 0 THEN 'mmwr_week missing or unreadable' WHEN l_linenumber IN (4, 5) THEN 'weekly_rate missing or unreadable' END
           AS reject_reason FROM lineitem""",
)
def _clean_numbers(t):
    line, tax = F.col("l_linenumber"), F.col("l_tax")
    rate = (
        F.when(line == 1, F.col("l_quantity").cast("int").cast("string"))
        .when(line == 2, "")
        .when(line == 3, F.lit(None))
        .when(line == 4, "abc")
        .when(line == 5, "1.5d")
        .when(line == 6, "1_000")
        .otherwise(" 12.5e1 ")
    )
    raw = t.table("lineitem").select(
        F.lit("RSV-NET").alias("surveillance_network"),
        F.lit("2000-2001").alias("season"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("week_ending_date"),
        F.lit("2001").alias("mmwr_year"),
        F.when(tax == 0, "1.0").when(tax < 0.03, F.lit(None)).otherwise("27").alias("mmwr_week"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("age_group"),
        *(F.lit(None).cast("string").alias(c) for c in ("sex", "race_ethnicity", "site", "cumulative_rate", "rate_type")),
        rate.alias("weekly_rate"),
        # The record id rides in the sequence column: cleaning keeps nothing else of the source.
        (F.col("l_orderkey") * 10 + line).alias("_seq"),
    )
    return landing.clean_hospitalization(raw).select(
        F.expr("_seq div 10").alias("record"),
        (F.col("_seq") % 10).cast("int").alias("line"),
        "week_ending_date",
        "mmwr_week",
        "age_group",
        "weekly_rate",
        "reject_reason",
    )


@query(
    "clean_ari",
    """SELECT record, CASE WHEN kind IN (0, 1, 2) THEN NULL ELSE day END AS week_end, geography, label, buildnumber,
         CASE WHEN kind IN (0, 1, 2) THEN 'week_end missing or unreadable'
              WHEN geography IS NULL THEN 'geography missing or unreadable'
              WHEN label = '' THEN 'label missing or unreadable' END AS reject_reason
       FROM (SELECT o_orderkey AS record, o_orderkey % 10 AS kind, CAST(o_orderdate AS DATE) AS day,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS geography,
               CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS label, '' AS buildnumber
             FROM orders)""",
)
def _clean_ari(t):
    # Missing, empty and malformed dates, a missing place and an empty label, each on a share of the orders.
    raw = t.table("orders").selectExpr(
        "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2024-13-45' "
        "WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END AS week_end",
        "nullif(o_orderstatus, 'P') AS geography",
        "IF(o_orderpriority = '5-LOW', '', o_orderpriority) AS label",
        "CAST(NULL AS STRING) AS buildnumber",
        "o_orderkey AS _seq",
    )
    return landing.clean_ari(raw).withColumnRenamed("_seq", "record")


@query(
    "clean_positivity",
    """SELECT event_id AS record, CAST(ts AS DATE) AS week_end, event_type AS pathogen,
         CASE WHEN kind IN (0, 1, 2) THEN NULL WHEN kind = 3 THEN 1500 ELSE value END AS percent_test_positivity,
         CASE WHEN kind IN (0, 1, 2) THEN 'percent_test_positivity missing or unreadable' END AS reject_reason
       FROM (SELECT *, event_id % 10 AS kind FROM events)""",
)
def _clean_positivity(t):
    raw = t.table("events").selectExpr(
        "date_format(ts, 'yyyy-MM-dd') AS week_end",
        "event_type AS pathogen",
        "CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '12%' WHEN 3 THEN '1.5e+3' "
        "ELSE CAST(value AS STRING) END AS percent_test_positivity",
        "event_id AS _seq",
    )
    return landing.clean_positivity(raw).withColumnRenamed("_seq", "record")


@query(
    "clean_wastewater",
    """SELECT record, CASE WHEN kind = 0 THEN '' ELSE plant END AS wwtp_id, day AS date_end,
         CAST(CASE WHEN kind = 1 THEN 0 WHEN kind = 2 THEN NULL ELSE quantity END AS INTEGER) AS population_served,
         CASE WHEN kind IN (3, 4) THEN 0 WHEN kind = 5 THEN NULL ELSE price END AS percentile,
         CASE WHEN kind = 0 THEN 'wwtp_id missing or unreadable' WHEN kind = 2 THEN 'population_served missing or unreadable'
              WHEN kind = 5 THEN 'percentile missing or unreadable' END AS reject_reason
       FROM (SELECT l_orderkey AS record, l_partkey % 11 AS kind, CAST(l_suppkey AS VARCHAR) AS plant,
               CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price
             FROM lineitem)""",
)
def _clean_wastewater(t):
    blank = ("wwtp_jurisdiction", "county_names", "county_fips", "date_start", "ptc_15d", "detect_prop_15d")
    raw = t.table("lineitem").selectExpr(
        "IF(l_partkey % 11 = 0, '', CAST(l_suppkey AS STRING)) AS wwtp_id",
        "date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") AS date_end",
        "CASE l_partkey % 11 WHEN 1 THEN '' WHEN 2 THEN '12.0' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END "
        "AS population_served",
        "CASE l_partkey % 11 WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'n/a' ELSE CAST(l_extendedprice AS STRING) END "
        "AS percentile",
        *(f"CAST(NULL AS STRING) AS {c}" for c in (*blank, "sampling_prior", "first_sample_date")),
        "l_orderkey AS _seq",
    )
    cleaned = landing.clean_wastewater(raw).withColumnRenamed("_seq", "record")
    return cleaned.select("record", "wwtp_id", "date_end", "population_served", "percentile", "reject_reason")


@query(
    "pages",
    """SELECT strftime(ts, '%Y-%m-%dT00:00:00.000') AS week_end, CAST(value AS VARCHAR) IS NOT NULL AS has_value,
         count(*) AS n FROM events GROUP BY 1, 2
       UNION ALL SELECT strftime(ts, '%Y-%m-%dT00:00:00.000'), false, count(*) FROM events GROUP BY 1""",
)
def _pages(t):
    # The second page lacks a key, as landing records may.
    first = raw_positivity(t.table("events"))
    both = landing.concat_pages([first, first.drop("percent_test_positivity")])
    has_value = F.col("percent_test_positivity").isNotNull().alias("has_value")
    return both.groupBy("week_end", has_value).agg(F.count("*").alias("n"))


def _as_landing(df: DataFrame, table: str, sequence: Column) -> DataFrame:
    """Typed rows as the text records a landing folder holds."""
    raw = TABLES[table].raw_schema.names[:-1]
    return df.select(*(F.col(c).cast("string").alias(c) for c in raw), sequence.cast("long").alias("_seq"))


def stage_landing(t: Sources, folder: str) -> None:
    last = F.when(F.col("rate_type") == "Estimated", 1).otherwise(0)
    zero = F.lit(0)
    for table, df, sequence in (
        ("ari_activity", t.ari, zero),
        ("hospitalization_rates", t.hosp, last),
        ("test_positivity", t.pos, zero),
        ("wastewater_sites", t.ww, zero),
    ):
        _as_landing(df, table, sequence).write.json(f"{folder}/{table}")


@query(
    "refresh_counts",
    """SELECT 'ari_activity' AS table_name, count(*) AS row_count FROM ari UNION ALL
       SELECT 'hospitalization_rates', count(*) FROM (SELECT DISTINCT surveillance_network, week_ending_date, age_group,
         sex, race_ethnicity, site FROM hosp) UNION ALL
       SELECT 'test_positivity', count(*) FROM pos UNION ALL
       SELECT 'wastewater_sites', count(*) FROM ww
         WHERE date_end > CAST(DATE '2001-12-01' - INTERVAL 365 DAY AS DATE)""",
    "ari",
    "hosp",
    "pos",
    "ww",
)
def _refresh_counts(t):
    folder = work_folder(t, "refresh")
    stage_landing(t, f"{folder}/landing")
    tables.declare_tables(t.spark, f"{folder}/tables")
    if not refresh.refresh_all(t.spark, f"{folder}/landing", f"{folder}/tables", as_of="2001-12-01"):
        raise RuntimeError("refresh failed")
    return refresh.table_counts(t.spark, f"{folder}/tables")


@query(
    "quarantined",
    """SELECT 'percent_test_positivity missing or unreadable' AS reject_reason, count(*) AS n,
         CAST(min(event_id) AS BIGINT) AS first_seq, CAST(max(event_id) AS BIGINT) AS last_seq FROM events WHERE value > 50
       HAVING count(*) > 0""",
)
def _quarantined(t):
    # Large values arrive as unreadable text.
    folder = work_folder(t, "quarantined")
    tables.declare_tables(t.spark, folder, ("test_positivity",))
    unreadable = F.when(F.col("value") > 50, "n/a").otherwise(F.col("value").cast("string"))
    raw = raw_positivity(t.table("events").withColumn("value", unreadable))
    refresh.load_batch(t.spark, folder, "test_positivity", raw)
    kept = t.spark.read.parquet(refresh.rejected_path(folder, "test_positivity"))
    return kept.groupBy("reject_reason").agg(
        F.count("*").alias("n"), F.min("_seq").alias("first_seq"), F.max("_seq").alias("last_seq")
    )


_LINE = """'{"week_end":"' || strftime(ts, '%Y-%m-%d') || '","pathogen":"' || event_type
           || '","percent_test_positivity":"n/a'"""


@query(
    "quarantined_records",
    f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'malformed record'
                ELSE 'percent_test_positivity missing or unreadable' END AS reject_reason,
         {_LINE} || CASE WHEN event_id % 2 = 0 THEN '' ELSE '"}}' END AS raw_record,
         CASE WHEN event_id % 2 = 1 THEN CAST(event_id AS BIGINT) END AS seq FROM events WHERE value > 50""",
)
def _quarantined_records(t):
    # Lines of landing files: of the large values half are unreadable, half break off within the value.
    folder = work_folder(t, "refused-records")
    tables.declare_tables(t.spark, folder, ("test_positivity",))
    start = F.concat(
        F.lit('{"week_end":"'),
        F.date_format("ts", "yyyy-MM-dd"),
        F.lit('","pathogen":"'),
        "event_type",
        F.lit('","percent_test_positivity":"'),
    )
    large = F.col("value") > 50
    text = F.when(large, "n/a").otherwise(F.col("value").cast("string"))
    end = F.when(large & (F.col("event_id") % 2 == 0), "").otherwise(F.concat(F.lit('","_seq":'), "event_id", F.lit("}")))
    lines = t.table("events").select(F.concat(start, text, end).alias("value"))
    lines.write.text(f"{folder}/landing/test_positivity")
    refresh.load_batch(
        t.spark, folder, "test_positivity", landing.read_landing(t.spark, f"{folder}/landing", "test_positivity")
    )
    kept = t.spark.read.parquet(refresh.rejected_path(folder, "test_positivity"))
    return kept.select("reject_reason", "raw_record", F.col("_seq").alias("seq"))


def _stored(t: Sources, purpose: str, name: str, df: DataFrame) -> str:
    """Folder of a table that holds the given rows."""
    folder = work_folder(t, purpose)
    tables.declare_tables(t.spark, folder, (name,))
    tables.upsert(t.spark, folder, name, df.withColumn("_seq", F.lit(0).cast("long")))
    return folder


@query("stored_latest", "SELECT label, count(*) AS count FROM ari_latest GROUP BY 1", "ari")
def _stored_latest(t):
    folder = _stored(t, "latest", "ari_activity", t.ari)
    return aggregates.risk_distribution(stored.newest(t.spark, folder, "ari_activity"))


@query(
    "stored_recent",
    """SELECT week_end, pathogen, round(percent_test_positivity, 8) + 0.0 AS percent_test_positivity FROM pos
       ORDER BY week_end DESC, pathogen LIMIT 200""",
    "pos",
)
def _stored_recent(t):
    folder = _stored(t, "recent", "test_positivity", t.pos)
    rows = stored.newest_rows(t.spark, folder, "test_positivity", 200)
    return tidied(snapshot.positivity(rows), "percent_test_positivity")


def _indexed(t: Sources, purpose: str, name: str, df: DataFrame, column: str, since: str, text: bool = False) -> str:
    """Folder of a table with an indexed column: rows before a date stored first, the others by a later load."""
    date = F.col(TABLES[name].partition)
    folder = _stored(t, purpose, name, df.filter(date < since))
    tables.declare_lookup(t.spark, folder, name, column, text)
    tables.upsert(t.spark, folder, name, df.filter(date >= since).withColumn("_seq", F.lit(1).cast("long")))
    return folder


@query(
    "stored_county",
    """SELECT date_end, percentile, ptc_15d, round(detect_prop_15d, 8) + 0.0 AS detect_prop_15d, population_served,
              county_names, wwtp_jurisdiction FROM ww WHERE county_fips = '00013'""",
    "ww",
)
def _stored_county(t):
    folder = _indexed(t, "county", "wastewater_sites", t.ww, "county_fips", "1997-01-01")
    return tidied(stored.stored_county(t.spark, folder, "00013"), "detect_prop_15d")


@query(
    "stored_like",
    """SELECT wwtp_id, date_end, county_names, percentile FROM ww WHERE county_names LIKE '%unty_1_%'""",
    "ww",
)
def _stored_like(t):
    folder = _indexed(t, "like", "wastewater_sites", t.ww, "county_names", "1997-01-01", text=True)
    rows = stored.rows_like(t.spark, folder, "wastewater_sites", "county_names", "unty_1_")
    return rows.select("wwtp_id", "date_end", "county_names", "percentile")


@query(
    "stored_history",
    """SELECT * FROM (SELECT week_end, geography, label,
         CAST(row_number() OVER (PARTITION BY geography ORDER BY week_end DESC) AS INTEGER) AS weeks_back FROM ari)
       WHERE weeks_back <= 12""",
    "ari",
)
def _stored_history(t):
    folder = _indexed(t, "history", "ari_activity", t.ari, "geography", "1997-01-01")
    return stored.stored_history(t.spark, folder, weeks=12)


def _counted(t: Sources, purpose: str, group: str = "") -> str:
    """Folder of a table with kept distinct counts: old dates stored with other codes first, then all dates as they are."""
    date, seq = F.col(TABLES["wastewater_sites"].partition), F.lit(1).cast("long")
    wrong = t.ww.filter(date < "1996-01-01").withColumn("county_fips", F.concat(F.lit("x"), "wwtp_id"))
    folder = _stored(t, purpose, "wastewater_sites", wrong)
    for column in ("wwtp_id", "county_fips"):
        tables.declare_distinct(t.spark, folder, "wastewater_sites", column, group)
    for batch in (t.ww.filter(date < "1997-01-01"), t.ww.filter(date >= "1997-01-01")):
        tables.upsert(t.spark, folder, "wastewater_sites", batch.withColumn("_seq", seq))
    return folder


@query(
    "stored_load_stats",
    "SELECT count(*) AS row_count, count(DISTINCT wwtp_id) AS sites, count(DISTINCT county_fips) AS counties FROM ww",
    "ww",
)
def _stored_load_stats(t):
    columns = {"sites": "wwtp_id", "counties": "county_fips"}
    return stored.stored_load_stats(t.spark, _counted(t, "distinct"), "wastewater_sites", columns)


@query(
    "stored_state_counts",
    """SELECT wwtp_jurisdiction AS state, count(DISTINCT wwtp_id) AS sites, count(DISTINCT county_fips) AS counties
       FROM ww GROUP BY 1""",
    "ww",
)
def _stored_state_counts(t):
    return stored.stored_state_counts(t.spark, _counted(t, "by-state", "wwtp_jurisdiction"))
