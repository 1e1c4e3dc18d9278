"""Raw landing records and the rules that turn them into typed rows.

A landing folder holds one sub-folder of JSON-lines files per table. All values
are text, keys may be missing, and ``_seq`` is the record's position in the
source, which Spark needs because files carry no row order.

Each cleaning function returns every input row with a ``reject_reason`` column:
``accepted`` keeps the good rows as the declared table, ``rejected`` the rest.
Records read from files, or marked by ``with_malformed``, also bring ``raw_record``:
the record as it came, a malformed line with its own text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from epiweave.schemas import TABLES

# --- Fixed values: number texts the source's own reader accepts ---------------
INTEGER_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
DECIMAL_TEXT = (
    r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"
)
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"


#: Text of a line that is no JSON record of the table; null for all others.
MALFORMED = "_malformed"
RAW_RECORD = "raw_record"


def landing_schema(table: str) -> StructType:
    return StructType([*TABLES[table].raw_schema.fields, StructField(MALFORMED, StringType())])


def read_landing(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All landing files (pages) of one table, untyped; a malformed line is a row of its own."""
    reader = spark.read.schema(landing_schema(table)).option("columnNameOfCorruptRecord", MALFORMED)
    return reader.json(f"{root.rstrip('/')}/{table}")


def with_malformed(raw: DataFrame) -> DataFrame:
    """Records that do not come from files, marked as well formed so that cleaning keeps their raw text."""
    return raw if MALFORMED in raw.columns else raw.withColumn(MALFORMED, F.lit(None).cast("string"))


def _raw_record(raw: DataFrame) -> list[Column]:
    """The record as it came; computed for refused rows only, as ``accepted`` drops it."""
    if MALFORMED not in raw.columns:
        return []
    fields = F.to_json(F.struct(*(c for c in raw.columns if c not in (MALFORMED, "_seq"))))
    return [F.coalesce(F.col(MALFORMED), fields).alias(RAW_RECORD), F.col(MALFORMED)]


def concat_pages(pages: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def iso_date(column: Column) -> Column:
    """Date from the first ten characters of an ISO stamp, else null."""
    day = F.substring(column, 1, 10)
    return F.when(day.rlike(DATE_TEXT), day.try_cast("date"))


def parse_decimal(column: Column) -> Column:
    plain = F.trim(F.translate(column, "_", ""))
    return F.when(column.rlike(DECIMAL_TEXT), plain.try_cast("double"))


def parse_integer(column: Column) -> Column:
    plain = F.trim(F.translate(column, "_", ""))
    return F.when(column.rlike(INTEGER_TEXT), plain.try_cast("int"))


def zero_filled(column: Column, parse: Callable[[Column], Column]) -> Column:
    """Blank reads as zero; unparsable stays null so the row can be rejected."""
    return F.when(blank(column), F.lit(0).cast("int")).otherwise(parse(column))


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def _day(name: str) -> Column:
    return iso_date(F.col(name)).alias(name)


def _decimal(name: str) -> Column:
    return zero_filled(F.col(name), parse_decimal).cast("double").alias(name)


def _judged(typed: DataFrame, *required: str) -> DataFrame:
    """Adds the first required column a row lacks, as the reason to refuse it.

    Values are parsed once, in the projection below this one.
    """
    kinds = dict(typed.dtypes)

    def lacking(name: str) -> Column:
        return blank(F.col(name)) if kinds[name] == "string" else F.col(name).isNull()

    reasons = [F.when(lacking(name), F.lit(f"{name} missing or unreadable")) for name in required]
    if MALFORMED in kinds:
        reasons.insert(0, F.when(F.col(MALFORMED).isNotNull(), F.lit("malformed record")))
    return typed.withColumn("reject_reason", F.coalesce(*reasons)).drop(MALFORMED)


def clean_ari(raw: DataFrame) -> DataFrame:
    typed = raw.select(_day("week_end"), "geography", "label", _text("buildnumber"), "_seq", *_raw_record(raw))
    return _judged(typed, "week_end", "geography", "label")


def clean_hospitalization(raw: DataFrame) -> DataFrame:
    def required_integer(name: str) -> Column:
        # Only a missing value defaults to 0 here; an empty text is unreadable.
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(parse_integer(F.col(name))).alias(name)

    typed = raw.select(
        _text("surveillance_network"),
        _text("season"),
        _day("week_ending_date"),
        required_integer("mmwr_year"),
        required_integer("mmwr_week"),
        _text("age_group", "Overall"),
        _text("sex", "Overall"),
        _text("race_ethnicity", "Overall"),
        _text("site"),
        _decimal("weekly_rate"),
        _decimal("cumulative_rate"),
        _text("rate_type"),
        "_seq",
        *_raw_record(raw),
    )
    return _judged(typed, "week_ending_date", "mmwr_year", "mmwr_week", "weekly_rate", "cumulative_rate")


def clean_positivity(raw: DataFrame) -> DataFrame:
    percent = parse_decimal(F.col("percent_test_positivity")).alias("percent_test_positivity")
    typed = raw.select(_day("week_end"), "pathogen", percent, "_seq", *_raw_record(raw))
    return _judged(typed, "week_end", "pathogen", "percent_test_positivity")


def clean_wastewater(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        _text("wwtp_jurisdiction"),
        "wwtp_id",
        _text("county_names"),
        _text("county_fips"),
        zero_filled(F.col("population_served"), parse_integer).alias("population_served"),
        _day("date_start"),
        _day("date_end"),
        _decimal("ptc_15d"),
        _decimal("detect_prop_15d"),
        _decimal("percentile"),
        _text("sampling_prior"),
        _day("first_sample_date"),
        "_seq",
        *_raw_record(raw),
    )
    return _judged(
        typed, "date_end", "wwtp_id", "population_served", "ptc_15d", "detect_prop_15d", "percentile"
    )


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ari_activity": clean_ari,
    "hospitalization_rates": clean_hospitalization,
    "test_positivity": clean_positivity,
    "wastewater_sites": clean_wastewater,
}


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("reject_reason IS NULL").drop("reject_reason", RAW_RECORD)


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("reject_reason IS NOT NULL")


def recent_only(df: DataFrame, as_of: str, days: int = 90, column: str = "date_end") -> DataFrame:
    """Rows dated strictly after ``as_of`` minus ``days``; the date reaches the scan."""
    return df.filter(F.col(column) > F.date_sub(F.lit(as_of).cast("date"), days))
