"""Incremental refresh of a stored aggregate (SNK-05 with STR-01).

Monthly files land below ``<landing>/delivery=<n>/Year=<y>/Month=<m>``. A run reads only the
files that arrived since the last one (file stream, ``availableNow``), reduces them to partial
sums per month, delivery and group, and writes those as one folder per micro-batch. The
aggregate is the sum of the partial sums of each month's newest delivery: a month that is sent
again under a higher delivery number retracts what its older delivery had added, whatever batch
that came in, and an older delivery that arrives late changes nothing. No flight is read twice.

A batch that is replayed after a failure overwrites its own folder, so every file counts exactly
once; a folder counts once its ``_SUCCESS`` marker is there. The table and its checkpoint belong
together. ``compact`` folds the batches into one folder, ``vacuum`` removes what it replaced once
no reader uses it. Partial sums are as many as months times groups, not flights.

Defined results: a sum over nothing but nulls is null, as in SQL. A delivery without rows leaves
no trace, so it does not retract anything. Before the first batch the aggregate has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.sources.files import ontime_schema
from tarmac.sources.materialize import finished_folders
from tarmac.session import release

PERIOD = ["YEAR", "MONTH"]
DELIVERY = "DELIVERY"


@dataclass(frozen=True)
class Refreshed:
    """An aggregate of additive sums: group columns and (output, source) pairs, by the names of
    the flights table; ``columns`` maps those to the names in the files."""

    keys: tuple[str, ...]
    sums: tuple[tuple[str, str], ...]
    columns: dict[str, str]

    def partial_keys(self) -> list[str]:
        return [*PERIOD, DELIVERY, *[k for k in self.keys if k not in PERIOD]]

    def rows(self, landed: DataFrame) -> DataFrame:
        need = dict.fromkeys([*PERIOD, *self.keys, *[s for _, s in self.sums]])
        return landed.select(*[F.col(self.columns[c]).alias(c) for c in need], F.col("delivery").alias(DELIVERY))

    def partials(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.partial_keys()).agg(*[F.sum(s).alias(o) for o, s in self.sums])

    def merged(self, partials: DataFrame, keys: list[str]) -> DataFrame:
        """Sums over ``keys`` of the newest delivery of each month."""
        newest = partials.groupBy(*PERIOD).agg(F.max(DELIVERY).alias(DELIVERY))
        return partials.join(newest, [*PERIOD, DELIVERY], "left_semi").groupBy(*keys) \
            .agg(*[F.sum(o).alias(o) for o, _ in self.sums])


def _landed_schema(names: list[str]) -> T.StructType:
    return T.StructType([*ontime_schema(names).fields, T.StructField("delivery", T.IntegerType())])


def refresh(spark: SparkSession, landing: str, names: list[str], table: str, checkpoint: str, spec: Refreshed) -> int:
    """Add every file that has arrived since the last run; returns the number of rows read."""
    landed = (spark.readStream.schema(_landed_schema(names)).option("header", True).option("dateFormat", "yyyy-MM-dd")
              .option("maxFilesPerTrigger", 1000).csv(landing))
    read = []

    def add(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        spec.partials(batch.observe(seen, F.count(F.lit(1)).alias("n"))).write.mode("overwrite") \
            .parquet(f"{table}/batch-{batch_id:012d}")
        read.append(seen.get["n"])

    run = spec.rows(landed).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(read)


def _live(spark: SparkSession, table: str) -> tuple[list[str], list[str]]:
    """Folders that make up the table now, and those that ``compact`` has replaced."""
    names = finished_folders(spark, table)
    bases = sorted(n for n in names if n.startswith("base-"))
    done = int(bases[-1].split("-")[1]) if bases else -1
    live = bases[-1:] + sorted(n for n in names if n.startswith("batch-") and int(n.split("-")[1]) > done)
    return live, [n for n in names if n not in live]


def partial_sums(spark: SparkSession, table: str, names: list[str], spec: Refreshed) -> DataFrame:
    live, _ = _live(spark, table)
    if not live:
        return spec.partials(spec.rows(spark.createDataFrame([], _landed_schema(names))))
    return spark.read.parquet(*[f"{table}/{n}" for n in live])


def read_aggregate(spark: SparkSession, table: str, names: list[str], spec: Refreshed) -> DataFrame:
    """The aggregate as of the last run."""
    return spec.merged(partial_sums(spark, table, names, spec), list(spec.keys))


def compact(spark: SparkSession, table: str, names: list[str], spec: Refreshed) -> None:
    """Fold all finished batches into one folder of partial sums of the newest deliveries.

    Run by one job at a time; readers see the old folders until the new one is finished.
    """
    live, _ = _live(spark, table)
    if len(live) > 1:
        last = max(int(n.split("-")[1]) for n in live)
        spec.merged(partial_sums(spark, table, names, spec), spec.partial_keys()).write.mode("overwrite") \
            .parquet(f"{table}/base-{last:012d}")


def vacuum(spark: SparkSession, table: str) -> int:
    """Remove the folders that ``compact`` replaced; call it when no reader holds them."""
    _, old = _live(spark, table)
    for n in old:
        release(spark, f"{table}/{n}")
    return len(old)
