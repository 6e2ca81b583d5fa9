"""Keyed tables: upserts that write the touched buckets only, swapped in by a manifest; quarantine and run log beside them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; the manifest names one folder for each, so it stays this small however large the table gets.
BUCKETS = 64
QUARANTINE = "record_id string, run_id string, provider string, entity_type string, provider_entity_id string, reason_code string, detail string, data_mode string, created_at timestamp"
RUNS = (
    "run_id string, provider string, resource_type string, status string, started_at timestamp, finished_at timestamp, position string, records_read long, records_accepted long, "
    "records_quarantined long, error_summary string, data_mode string"
)


class ConcurrentWrite(RuntimeError):
    """Another writer has swapped in a version since this one was read."""


@dataclass(frozen=True)
class Written:
    """What an upsert did: rows with new keys, stored rows of which it changed a value, and offered rows in all."""

    inserted: int
    changed: int
    offered: int


@dataclass(frozen=True)
class KeyedTable:
    """A table of Parquet files with unique keys, dealt to buckets by the hash of the key.

    A version is a manifest: the folder of each bucket's files, and the last batch of each writer. A write stages whole
    buckets in a folder of its own and then names a new manifest, which only one writer can do; until then, and if the
    write breaks off, readers see the version before. Buckets without an arriving key keep their files."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """A new table, or that which is there: its schema and keys must then be these."""
        shape = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        table = cls(spark, path, tuple(keys), shape, buckets)
        if table.version():
            return cls.at(spark, path, shape, keys)
        table._commit(1, {"keys": keys, "buckets": buckets, "schema": shape.jsonValue(), "folders": {}, "writers": {}})
        return table

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: T.StructType | None = None, keys: list[str] | None = None) -> KeyedTable:
        table = cls(spark, path, (), T.StructType(), 0)
        known = table.manifest()
        shape = T.StructType.fromJson(known["schema"])
        if schema is not None and schema.simpleString() != shape.simpleString() or keys is not None and list(keys) != known["keys"]:
            raise ValueError(f"the table at {path} has other columns or keys")
        return cls(spark, path, tuple(known["keys"]), shape, known["buckets"])

    def version(self) -> int:
        """The number of the newest manifest; 0 without any."""
        found = self._files.globStatus(self._hadoop.fs.Path(f"{self.path}/_manifests/*.json")) or []
        return max((int(f.getPath().getName().removesuffix(".json")) for f in found), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/_manifests/{version:08d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default."""
        return self._rows(self.manifest(version)["folders"]).drop("_bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows with the given keys; only the files of their buckets are read."""
        folders = self.manifest()["folders"]
        wanted = {str(r[0]) for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        return self._rows({b: f for b, f in folders.items() if b in wanted}).drop("_bucket").join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi").select(*self.schema.names)

    def upsert(self, rows: DataFrame, order: list[str], update: list[str] | None = None, batch: tuple[str, int] | None = None) -> Written:
        """Offers rows in the order of the given columns. A key that isn't stored takes its first row; then each row in
        turn sets the update columns (default: none, what came first stays). Null keys are keys.

        The order must be total: of rows with equal places any may count as the first. batch names a writer and its
        ascending batch number: a batch that the table already has does nothing and gives the counts of its first time.
        Rows meet stored ones in one shuffle by bucket; the touched buckets are all that is read or written."""
        version = self.version()
        known = self.manifest(version)
        done = known["writers"].get(batch[0]) if batch else None
        if done and done["number"] >= batch[1]:
            return Written(*done["written"]) if done["number"] == batch[1] else Written(0, 0, 0)
        folder, update = f"{self.path}/data/{uuid.uuid4().hex}", list(update or [])
        names = self.schema.names
        place = [c for c in order if c not in names]
        arriving = rows.select(*names, *place, F.lit(True).alias("_new"), self._bucket().alias("_bucket"))
        # At most as many numbers as buckets.
        touched = {str(r[0]) for r in arriving.select("_bucket").distinct().collect()}
        stored = self._rows({b: f for b, f in known["folders"].items() if b in touched})
        pool = stored.withColumn("_new", F.lit(False)).unionByName(arriving, allowMissingColumns=True).repartition("_bucket")
        at = F.struct("_new", *order)
        fixed = [c for c in names if c not in update and c not in self.keys]
        counts = [F.min("_new").alias("_only_new"), F.count_if("_new").alias("_offered"), F.min_by(F.struct(*names), at).alias("_first")]
        grouped = pool.groupBy("_bucket", *self.keys).agg(*counts, F.max_by(F.struct(*(update or names)), at).alias("_last"))
        merged = grouped.select("_bucket", *self.keys, "_only_new", "_offered", F.col("_first").alias("_f"), *(F.col(f"_first.{c}").alias(c) for c in fixed), *(F.col(f"_last.{c}").alias(c) for c in update if c not in self.keys))
        differs = ~F.struct(*(F.col(c) for c in names)).eqNullSafe(F.struct(*(F.col(f"_f.{c}") for c in names)))
        counts = [F.count_if("_only_new").alias("inserted"), F.count_if(~F.col("_only_new") & differs).alias("changed"), F.coalesce(F.sum("_offered"), F.lit(0)).alias("offered")]
        # Counted in a job of its own: an observed metric would leave the session with state that model fits can't ship.
        counted = merged.agg(*counts).first().asDict() if touched else {}
        if touched:
            merged.select(*names, "_bucket").write.partitionBy("_bucket").parquet(folder)
        written = [int(counted.get(k, 0)) for k in ("inserted", "changed", "offered")]
        folders = known["folders"] | {b: f"{folder}/_bucket={b}" for b in touched}
        writers = known["writers"] | ({batch[0]: {"number": batch[1], "written": written}} if batch else {})
        self._commit(version + 1, known | {"folders": folders, "writers": writers})
        return Written(*written)

    def discard_unused(self, keep: int = 2) -> int:
        """Removes what only versions before the newest `keep` ones, or writes that broke off, have left. Not to be run
        beside a write. Returns the number of folders that went."""
        newest = self.version()
        used = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in range(max(1, newest - keep + 1), newest + 1) for f in self.manifest(v)["folders"].values()}
        found = self._files.globStatus(self._hadoop.fs.Path(f"{self.path}/data/*")) or []
        gone = [f.getPath() for f in found if f.getPath().getName() not in used]
        for folder in gone:
            self._files.delete(folder, True)
        for old in range(1, newest - keep + 1):
            self._files.delete(self._hadoop.fs.Path(f"{self.path}/_manifests/{old:08d}.json"), False)
        return len(gone)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.struct(*self.keys)), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[str, str]) -> DataFrame:
        shape = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(self.schema).parquet(*folders.values())
        return rows.withColumn("_bucket", self._bucket())

    def _commit(self, version: int, manifest: dict) -> None:
        """Writes the manifest beside its place and moves it there, which fails if that version has been taken."""
        path, target = self._hadoop.fs.Path, f"{self.path}/_manifests/{version:08d}.json"
        staged = path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._files.create(staged, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = self._hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.NONE
        try:
            qualified = self._files.makeQualified
            context.rename(qualified(staged), qualified(path(target)), options)
        except Exception as error:
            self._files.delete(staged, False)
            if "FileAlreadyExists" in str(error):
                raise ConcurrentWrite(f"version {version} of {self.path} has been written by another") from error
            raise

    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop

    @property
    def _files(self):
        return self._hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Intake:
    """A canonical table with its quarantine and run log: what a run takes in, what it refuses, and that it ran."""

    table: KeyedTable
    quarantine: KeyedTable
    runs: KeyedTable

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> Intake:
        return cls(
            KeyedTable.create(spark, f"{path}/table", schema, keys, buckets), KeyedTable.create(spark, f"{path}/quarantine", QUARANTINE, ["record_id"], buckets),
            KeyedTable.create(spark, f"{path}/runs", RUNS, ["run_id"], 1),
        )

    def run(self, rows: DataFrame, reason: Column, run: dict, order: list[str], update: list[str] | None = None, entity_id: Column | None = None, detail: Column | None = None, parents: tuple[DataFrame, str] | None = None) -> dict:
        """One run over rows: those without a reason go into the table, the others to quarantine with it, and a row of
        the run log says how many. parents (rows, key) refuses rows whose key isn't among them as missing_parent. run
        names run_id, provider, resource_type, data_mode and the times; with a number `batch`, a run that is repeated
        after it broke off between the tables does only what is missing. Rows that a run refuses more than once for the
        same reason have one record. If a write fails, the log says so and the error goes on."""
        batch = (run["provider"], run["batch"]) if "batch" in run else None
        tagged = rows.withColumn("_reason", reason)
        if parents is not None:
            known = parents[0].select(F.col(parents[1]).alias("_parent")).distinct().withColumn("_known", F.lit(True))
            tagged = tagged.join(known, F.col(parents[1]) == F.col("_parent"), "left").withColumn("_reason", F.coalesce("_reason", F.when(F.col("_known").isNull(), "missing_parent"))).drop("_parent", "_known")
        fields = {k: run.get(k) for k in ("run_id", "provider", "resource_type", "started_at", "finished_at", "position", "data_mode")}
        ident = F.lit(None).cast("string") if entity_id is None else entity_id.cast("string")
        said = F.lit(None).cast("string") if detail is None else detail
        refused = tagged.where(F.col("_reason").isNotNull()).select(
            F.sha2(F.to_json(F.struct(F.lit(run["run_id"]).alias("run"), F.col("_reason"), ident.alias("id"), F.struct(*(F.col(c) for c in rows.columns)).alias("row")), {"ignoreNullFields": "false"}), 256).alias("record_id"),
            F.lit(run["run_id"]).alias("run_id"), F.lit(run["provider"]).alias("provider"), F.lit(run["resource_type"]).alias("entity_type"), ident.alias("provider_entity_id"),
            F.col("_reason").alias("reason_code"), said.alias("detail"), F.lit(run["data_mode"]).alias("data_mode"), F.lit(run.get("finished_at")).cast("timestamp").alias("created_at"),
        )
        try:
            kept = self.table.upsert(tagged.where(F.col("_reason").isNull()).drop("_reason"), order, update, batch)
            away = self.quarantine.upsert(refused, ["record_id"], batch=batch)
            log = {"status": "succeeded" if not away.offered else "partial" if kept.offered else "quarantined", "records_read": kept.offered + away.offered, "records_accepted": kept.offered, "records_quarantined": away.offered, "error_summary": None}
        except Exception as error:
            self._log(fields | {"status": "failed", "records_read": 0, "records_accepted": 0, "records_quarantined": 0, "error_summary": f"{type(error).__name__}: {error}"[:500]}, None)
            raise
        self._log(fields | log, batch)
        return log

    def _log(self, row: dict, batch: tuple[str, int] | None) -> None:
        columns = self.runs.schema.names
        self.runs.upsert(self.runs.spark.createDataFrame([tuple(row[c] for c in columns)], self.runs.schema), ["run_id"], ["status", "finished_at", "records_read", "records_accepted", "records_quarantined", "error_summary"], batch)


def tee(writer: str, *sinks: Callable[[DataFrame, tuple[str, int]], object]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch is computed once and goes to every sink with the writer's name and its number.
    Sinks pass the pair on as the batch of an upsert, so that a batch that is repeated after a failure between two sinks
    adds nothing to the first and is made up for in the second."""

    def both(rows: DataFrame, number: int) -> None:
        held = rows.persist()
        try:
            for sink in sinks:
                sink(held, (writer, number))
        finally:
            held.unpersist()

    return both
