"""Lazily-built shared frames for one (session, data folder).

Shared tables (flights, dimensions, features, classes) are loaded or, at
their first use, built and stored by a job; what is derived from them is lazy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import layout
from tarmac.plans import dims
from tarmac.session import ship_package
from tarmac.sources import tables
from tarmac.sources.materialize import gathered, materialize, small_splits, source_key, table_path

FLIGHT_COLUMNS = tables.FLIGHT_COLUMNS
TOP_AIRPORTS = 20  # airports per year that count as major
# columns that lookups name: dates stand for year, month and week, airports for city and state
LOOKUP_COLUMNS = ["CARRIER", "ORIGIN", "DEST", "FL_DATE"]
LOOKUP_BLOOMS = ["TAIL_NUM", "ORIGIN_CITY_NAME", "DEST_CITY_NAME"]


def _code_digest(root: str | None = None) -> str:
    """Digest of every module that can take part in building a stored table
    (with the parameters written in them): a code change never reads tables
    that older code built."""
    import hashlib
    from pathlib import Path

    here = Path(root) if root else Path(__file__).resolve().parent.parent
    h = hashlib.sha1()
    for part in ("sources", "plans", "operators", "functions"):
        for f in sorted((here / part).glob("*.py")):
            h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()[:12]


CODE_DIGEST = _code_digest()


class Ctx:
    """``tag`` separates stored tables of one run from others (bench uses a
    fresh tag so that it measures the builds)."""

    def __init__(self, spark: SparkSession, sf_dir: str, tag: str = ""):
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.tag = tag

    @cached_property
    def fl(self) -> DataFrame:
        """The flights table, built once from the driver tables and stored
        as parquet in the shared checkpoint folder (load-or-build). The rows
        are gathered and sorted by year as keys, before they get wide."""
        srcs = ["lineitem", "orders", "supplier", "customer", "part"]
        path = table_path(self.spark, "flights", CODE_DIGEST, self.tag, *source_key(self.sf_dir, srcs))
        t = materialize(self.spark, path, self._build_flights, partition_by=["YEAR"], arranged=True)
        return t.select(*FLIGHT_COLUMNS)

    def _build_flights(self) -> DataFrame:
        keys = gathered(tables.flight_keys(self.spark, self.sf_dir), ["yr"]).sortWithinPartitions("yr")
        return tables.flights_of(keys)

    @cached_property
    def monthly_layout(self) -> DataFrame:
        """SNK-08: the flights laid out by (YEAR, MONTH); built once."""
        return self._stored("flights_by_month", lambda: self.fl, ["YEAR", "MONTH"])

    @cached_property
    def lookup_layout(self) -> DataFrame:
        """SNK-08: the flights along one curve over date, carrier and airports, with Bloom
        filters on the tail number and the city names; built once."""
        fl = self.fl
        with small_splits(self.spark):
            return self._stored("flights_lookup", lambda: layout.ordered(fl, LOOKUP_COLUMNS),
                                options=layout.bloom_options(LOOKUP_BLOOMS))

    @cached_property
    def carrier_bits(self) -> DataFrame:
        """The carriers of each route and month as bitmaps; built once."""
        from tarmac.operators import aggregates as agg
        from tarmac.operators import classify as cls
        codes = lambda: cls.label_codes(self.fl, "CARRIER").select(F.col("VALUE").alias("CARRIER"), "CODE")
        return self._stored("carrier_bits", lambda: agg.carrier_bits(self.fl, codes()))

    @cached_property
    def camel(self) -> DataFrame:
        return tables.flights_camel(self.fl)

    @cached_property
    def airports(self) -> DataFrame:
        return tables.airports(self.spark, self.sf_dir)

    @cached_property
    def carriers(self) -> DataFrame:
        return tables.carriers(self.spark, self.sf_dir)

    def _stored(self, name: str, build, partition_by: list[str] | None = None,
                options: dict[str, str] | None = None) -> DataFrame:
        """Load-or-build a derived table next to the flights table (the
        reference keeps the same tables: major_airlines.csv,
        major_airports.csv, the ``flights`` subset table)."""
        srcs = ["lineitem", "orders", "supplier", "customer", "part", "nation"]
        path = table_path(self.spark, name, CODE_DIGEST, self.tag, *source_key(self.sf_dir, srcs))
        return materialize(self.spark, path, build, partition_by=partition_by, options=options)

    @cached_property
    def ranks(self) -> DataFrame:
        return self._stored("ranks", lambda: tables.ranks(self.fl))

    @cached_property
    def requests(self) -> DataFrame:
        return self._stored("requests", lambda: tables.requests(self.fl))

    @cached_property
    def major_airlines(self) -> DataFrame:
        return self._stored("major_airlines", lambda: dims.major_airlines(self.fl, self.carriers))

    @cached_property
    def major_airports(self) -> DataFrame:
        return self._stored("major_airports", lambda: dims.major_airports(self.fl, self.airports, TOP_AIRPORTS))

    @cached_property
    def subset(self) -> DataFrame:
        """Flights of major carriers between major airports, stored by YEAR
        so that slices of a year prune the rest."""
        t = self._stored("flights_subset",
                         lambda: dims.flights_subset(self.fl, self.major_airlines, self.major_airports), ["YEAR"])
        return t.select(*dims.SUBSET_COLUMNS, "WEEK_OF_YEAR")

    @cached_property
    def hubs(self) -> DataFrame:
        return self._stored("large_hubs", lambda: dims.large_hubs(self.ranks))

    @cached_property
    def airport_base(self) -> DataFrame:
        """Origin x destination aggregates with coordinates (stored)."""
        from tarmac.plans import features as feat
        return self._stored("airport_base", lambda: feat.airport_base(self.fl, self.airports))

    @cached_property
    def airport_features(self) -> DataFrame:
        """Imputed, normalised airport features (stored; the reference keeps
        its aggregate tables the same way)."""
        from tarmac.plans import features as feat
        return self._stored("airport_features", lambda: feat.airport_features(self.fl, self.airports))

    @cached_property
    def route_features(self) -> DataFrame:
        from tarmac.plans import features as feat
        return self._stored("route_features", lambda: feat.route_features(self.fl))

    @cached_property
    def airport_clusters(self) -> DataFrame:
        from tarmac.plans import features as feat
        return self._stored("airports_clusters", lambda: feat.airport_clusters(self.airport_features))

    @cached_property
    def route_clusters(self) -> DataFrame:
        from tarmac.plans import features as feat
        return self._stored("flights_clusters", lambda: feat.route_clusters(self.route_features))

    @cached_property
    def model_carriers(self) -> DataFrame:
        """Carriers of the modelling query (in every year up to 2015)."""
        return self._stored("model_carriers", lambda: dims.major_carriers(self.fl, max_year=2015))

    @cached_property
    def train_codes(self) -> dict[str, DataFrame]:
        """Label codes of the training rows (stored once; one small table)."""
        from tarmac.operators import classify as cls

        def build() -> DataFrame:
            clean = self.subset.dropna(how="any")
            parts = [cls.label_codes(clean, c).select(F.lit(c).alias("FEATURE"), "VALUE", "CODE")
                     for c in cls.ENCODED]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        codes = self._stored("label_codes", build)
        return {c: codes.where(F.col("FEATURE") == c).select("VALUE", "CODE") for c in cls.ENCODED}

    @cached_property
    def train(self) -> DataFrame:
        """Encoded training rows (CLS-01), stored once and shared by the fit,
        the evaluation and request scoring."""
        from tarmac.operators import classify as cls

        return self._stored("training_frame", lambda: cls.encode(self.subset.dropna(how="any"), self.train_codes)
                            .select(*self.subset.columns))

    @cached_property
    def sample(self) -> DataFrame:
        return dims.year_sample(self.fl, self.major_airlines, self.hubs)
