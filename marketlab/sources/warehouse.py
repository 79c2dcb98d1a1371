"""Keyed tables on Parquet and artifact sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlab.session import materialise
from marketlab.sources.schemas import DAY_OF, KEYS, TABLES

LOG = "day string, version long, batch string"


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Last-wins merge by key: new rows replace old ones, later rows earlier ones.

    A max-by aggregate keyed by the primary key; rows of one rank are told apart
    by a hash of their values, so the result is repeatable. Without keys rows
    are appended.
    """
    cols = existing.columns
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.select(*cols).withColumn("_src", F.lit(1)))
    if not keys:
        return both.drop("_src")
    rest = [c for c in cols if c not in keys]
    rank = F.struct(F.col("_src"), *[F.col(c) for c in order], F.xxhash64(*rest).alias("_tie"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*").select(*cols)


class Warehouse:
    """Parquet tables under one folder, a folder per day and write version.

    An upsert reads and rewrites only the days it touches, as a new version.
    What a reader sees is listed in a small log (day, version), written after
    the data: a half-finished write is never seen, and only listed folders are
    opened; the next write of that version clears them first. A write can carry
    the name of its batch; a batch that the log lists is not written again. One writer per table at a time; :meth:`retire` deletes what the log
    no longer points to.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _entries(self, table: str) -> DataFrame:
        at = f"{self.root}/_log/{table}"
        return self.spark.read.schema(LOG).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], LOG)

    def _log(self, table: str) -> list[tuple[str, int]]:
        """All (day, version) written so far; empty only if nothing was ever written."""
        return [(r["day"], r["version"]) for r in self._entries(table).select("day", "version").collect()]

    def written(self, table: str, batch: str) -> bool:
        return not self._entries(table).where(F.col("batch") == batch).isEmpty()

    def _live(self, table: str) -> list[tuple[str, int]]:
        """The newest version of every day; without a key every write counts."""
        log = self._log(table)
        return sorted(log) if not KEYS[table] else sorted({d: v for d, v in sorted(log)}.items())

    def _folder(self, table: str, day: str, version: int) -> str:
        return f"{self.path(table)}/day={day}/version={version}"

    def _load(self, table: str, live: Sequence[tuple[str, int]]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[self._folder(table, d, v) for d, v in live])

    def read(self, table: str) -> DataFrame:
        return self._load(table, self._live(table))

    def upsert(self, table: str, new: DataFrame, order: Sequence[str] = (), batch: str | None = None) -> DataFrame:
        """Merge rows into a table and return the merged table; a batch already written changes nothing."""
        if batch is not None and self.written(table, batch):
            return self.read(table)
        spec = TABLES[table]
        rows = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.fields])
        day = F.coalesce(F.date_format(DAY_OF[table], "yyyy-MM-dd"), F.lit("none")) if table in DAY_OF else F.lit("all")
        rows = materialise(rows)
        touched = {r[0] for r in rows.select(day).distinct().collect()}  # days of one batch
        if not touched:
            return self.read(table)
        version = max((v for _, v in self._log(table)), default=0) + 1
        if KEYS[table]:
            old = self._load(table, [x for x in self._live(table) if x[0] in touched])
            rows = upsert(old, rows, KEYS[table], order)
        for d in touched:
            delete(self.spark, self._folder(table, d, version))  # left by a write that never reached the log
        rows.withColumns({"day": day, "version": F.lit(version).cast("long")}).write.mode("append").partitionBy("day", "version").parquet(self.path(table))
        self.spark.createDataFrame([(d, version, batch) for d in sorted(touched)], LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/_log/{table}")
        return self.read(table)

    def retire(self, table: str) -> int:
        """Delete the folders of versions that newer ones replaced; no reader may still use them."""
        live = set(self._live(table))
        old = [x for x in self._log(table) if x not in live]
        return sum(delete(self.spark, self._folder(table, d, v)) for d, v in old)


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.delete(p, True))


# ------------------------------------------------------------------- sinks


def write_frames(frames: Mapping[str, DataFrame], root: str, strategy: str, csv: Sequence[str] = ()) -> list[str]:
    """One Parquet folder per named frame, partitioned by strategy; small ones also as CSV."""
    done = []
    for name, df in frames.items():
        out = df if "strategy" in df.columns else df.withColumn("strategy", F.lit(strategy))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(f"{root}/{name}")
        if name in csv:
            df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/csv/{strategy}/{name}")
        done.append(name)
    return done


def write_run(frames: Mapping[str, DataFrame], summary: DataFrame, root: str) -> None:
    """Run-level reports as Parquet and the run summary as JSON."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/run_summary")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a stated schema; a path that does not exist is an empty frame, any other fault an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)
