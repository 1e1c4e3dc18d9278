"""Table schemas, keys and the fixed dimension values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TEXT, DATE, INT, REAL = StringType(), DateType(), IntegerType(), DoubleType()


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


@dataclass(frozen=True)
class Table:
    """Declared table: schema, key, and the column its files are split by."""

    name: str
    description: str
    schema: StructType
    key: tuple[str, ...]
    partition: str

    @property
    def raw_schema(self) -> StructType:
        """Landing records: the same fields as text, plus the source position."""
        fields = [StructField(f.name, TEXT) for f in self.schema.fields]
        return StructType([*fields, StructField("_seq", LongType())])


TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "ari_activity",
            "Acute respiratory illness activity level by geography and week",
            _struct(week_end=DATE, geography=TEXT, label=TEXT, buildnumber=TEXT),
            ("week_end", "geography"),
            "week_end",
        ),
        Table(
            "hospitalization_rates",
            "Hospitalization rates by network, site, stratum and week",
            _struct(
                surveillance_network=TEXT,
                season=TEXT,
                week_ending_date=DATE,
                mmwr_year=INT,
                mmwr_week=INT,
                age_group=TEXT,
                sex=TEXT,
                race_ethnicity=TEXT,
                site=TEXT,
                weekly_rate=REAL,
                cumulative_rate=REAL,
                rate_type=TEXT,
            ),
            # rate_type and season are not part of the key.
            ("surveillance_network", "week_ending_date", "age_group", "sex", "race_ethnicity", "site"),
            "week_ending_date",
        ),
        Table(
            "test_positivity",
            "Percent of positive tests by pathogen and week",
            _struct(week_end=DATE, pathogen=TEXT, percent_test_positivity=REAL),
            ("week_end", "pathogen"),
            "week_end",
        ),
        Table(
            "wastewater_sites",
            "Wastewater viral activity by treatment plant and reporting period",
            _struct(
                wwtp_jurisdiction=TEXT,
                wwtp_id=TEXT,
                county_names=TEXT,
                county_fips=TEXT,
                population_served=INT,
                date_start=DATE,
                date_end=DATE,
                ptc_15d=REAL,
                detect_prop_15d=REAL,
                percentile=REAL,
                sampling_prior=TEXT,
                first_sample_date=DATE,
            ),
            ("wwtp_id", "date_end"),
            "date_end",
        ),
        Table(
            "forecasts",
            "Forecast values with bounds",
            _struct(
                forecast_date=DATE,
                target_date=DATE,
                geography=TEXT,
                virus=TEXT,
                predicted_rate=REAL,
                lower_bound=REAL,
                upper_bound=REAL,
                model_version=TEXT,
            ),
            ("forecast_date", "target_date", "geography", "virus", "model_version"),
            "forecast_date",
        ),
        Table(
            "anomalies",
            "Detected rate anomalies",
            _struct(
                detected_date=DATE,
                geography=TEXT,
                metric=TEXT,
                value=REAL,
                z_score=REAL,
                severity=TEXT,
                description=TEXT,
            ),
            ("detected_date", "geography", "metric"),
            "detected_date",
        ),
    )
}

# The four tables that are loaded from landing records, in load order.
LANDING_TABLES = ("ari_activity", "hospitalization_rates", "test_positivity", "wastewater_sites")

# --- Fixed values: labels, networks and their relations -----------------------
RISK_LEVELS = {
    "Minimal": 0,
    "Very Low": 1,
    "Low": 2,
    "Moderate": 3,
    "High": 4,
    "Very High": 5,
}
HIGH_LABELS = ("High", "Very High")
UNAVAILABLE_LABEL = "Data Unavailable"
VIRUS_NETWORKS = {
    "COVID-19": "COVID-NET",
    "Influenza": "FluSurv-NET",
    "RSV": "RSV-NET",
}

# --- Fixed values: state or territory -> postal code --------------------------
STATE_CODES = {
    "Alabama": "AL",
    "Alaska": "AK",
    "Arizona": "AZ",
    "Arkansas": "AR",
    "California": "CA",
    "Colorado": "CO",
    "Connecticut": "CT",
    "Delaware": "DE",
    "District of Columbia": "DC",
    "Florida": "FL",
    "Georgia": "GA",
    "Hawaii": "HI",
    "Idaho": "ID",
    "Illinois": "IL",
    "Indiana": "IN",
    "Iowa": "IA",
    "Kansas": "KS",
    "Kentucky": "KY",
    "Louisiana": "LA",
    "Maine": "ME",
    "Maryland": "MD",
    "Massachusetts": "MA",
    "Michigan": "MI",
    "Minnesota": "MN",
    "Mississippi": "MS",
    "Missouri": "MO",
    "Montana": "MT",
    "Nebraska": "NE",
    "Nevada": "NV",
    "New Hampshire": "NH",
    "New Jersey": "NJ",
    "New Mexico": "NM",
    "New York": "NY",
    "North Carolina": "NC",
    "North Dakota": "ND",
    "Ohio": "OH",
    "Oklahoma": "OK",
    "Oregon": "OR",
    "Pennsylvania": "PA",
    "Puerto Rico": "PR",
    "Rhode Island": "RI",
    "South Carolina": "SC",
    "South Dakota": "SD",
    "Tennessee": "TN",
    "Texas": "TX",
    "Utah": "UT",
    "Vermont": "VT",
    "Virginia": "VA",
    "Washington": "WA",
    "West Virginia": "WV",
    "Wisconsin": "WI",
    "Wyoming": "WY",
}

# --- Fixed values: state -> (latitude, longitude); the 50 states only ---------
STATE_COORDINATES = {
    "Alabama": (32.806671, -86.791130),
    "Alaska": (61.370716, -152.404419),
    "Arizona": (33.729759, -111.431221),
    "Arkansas": (34.969704, -92.373123),
    "California": (36.116203, -119.681564),
    "Colorado": (39.059811, -105.311104),
    "Connecticut": (41.597782, -72.755371),
    "Delaware": (39.318523, -75.507141),
    "Florida": (27.766279, -81.686783),
    "Georgia": (33.040619, -83.643074),
    "Hawaii": (21.094318, -157.498337),
    "Idaho": (44.240459, -114.478828),
    "Illinois": (40.349457, -88.986137),
    "Indiana": (39.849426, -86.258278),
    "Iowa": (42.011539, -93.210526),
    "Kansas": (38.526600, -96.726486),
    "Kentucky": (37.668140, -84.670067),
    "Louisiana": (31.169546, -91.867805),
    "Maine": (44.693947, -69.381927),
    "Maryland": (39.063946, -76.802101),
    "Massachusetts": (42.230171, -71.530106),
    "Michigan": (43.326618, -84.536095),
    "Minnesota": (45.694454, -93.900192),
    "Mississippi": (32.741646, -89.678696),
    "Missouri": (38.456085, -92.288368),
    "Montana": (46.921925, -110.454353),
    "Nebraska": (41.125370, -98.268082),
    "Nevada": (38.313515, -117.055374),
    "New Hampshire": (43.452492, -71.563896),
    "New Jersey": (40.298904, -74.521011),
    "New Mexico": (34.840515, -106.246597),
    "New York": (42.165726, -74.948051),
    "North Carolina": (35.630066, -79.806419),
    "North Dakota": (47.528912, -99.901810),
    "Ohio": (40.388783, -82.764915),
    "Oklahoma": (35.565342, -96.928917),
    "Oregon": (44.572021, -122.070938),
    "Pennsylvania": (40.590752, -77.209755),
    "Rhode Island": (41.680893, -71.511780),
    "South Carolina": (33.856892, -80.945007),
    "South Dakota": (44.299782, -99.438828),
    "Tennessee": (35.747845, -86.692345),
    "Texas": (31.054487, -97.563461),
    "Utah": (40.150032, -111.862434),
    "Vermont": (44.045876, -72.710686),
    "Virginia": (37.769337, -78.169968),
    "Washington": (47.400902, -121.490494),
    "West Virginia": (38.491226, -80.954453),
    "Wisconsin": (44.268543, -89.616508),
    "Wyoming": (42.755966, -107.302490),
}


def state_dimension(spark: SparkSession) -> DataFrame:
    """geography, code, lat, lng — 52 rows, coordinates null where unknown."""
    rows = [(name, code, *STATE_COORDINATES.get(name, (None, None))) for name, code in STATE_CODES.items()]
    return spark.createDataFrame(rows, "geography string, code string, lat double, lng double")


def network_dimension(spark: SparkSession) -> DataFrame:
    """virus, surveillance_network — 3 rows."""
    return spark.createDataFrame(list(VIRUS_NETWORKS.items()), "virus string, surveillance_network string")
