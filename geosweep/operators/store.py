"""A store of detections with merges and tombstones, on Parquet folders that all executors share.

Rows lie in partitions (a pass, say).  A step rewrites only the partitions that it touches, into folders of its own
version, and takes effect with the one log row that names them, so that readers see whole versions and a
step that was broken off leaves nothing.  Every step has an epoch: one that the log has already changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

LOG = "version int, epoch string, partition long, kind string"


class Store:
    """Rows by ``key`` in partitions named by the long column ``partition``; ``deleted_at`` marks tombstones."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str = "det_id", partition: str = "pass_id"):
        self.spark, self.folder, self.key, self.partition = spark, folder.rstrip("/"), key, partition
        given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.columns = given.fieldNames()
        self.schema = T.StructType([f for f in given.fields if f.name != "deleted_at"] + [T.StructField("deleted_at", T.TimestampType())])

    def log(self) -> DataFrame:
        """(version, epoch, partition, kind): which partitions each step wrote."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log/*")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], LOG)

    def version(self) -> int:
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def rows(self, version: int | None = None, partitions: list[int] | None = None) -> DataFrame:
        """All rows, tombstones too, as they were after a version (the last one, unless it is given)."""
        steps = self.log() if version is None else self.log().where(F.col("version") <= version)
        if partitions is not None:
            steps = steps.where(F.col("partition").isin(partitions))
        newest = steps.where(F.col("partition").isNotNull()).groupBy("partition").agg(F.max("version").alias("version")).collect()  # a row a partition
        # tombstones stay, so that a partition that was ever written has rows, and a folder, in each of its versions
        paths = [f"{self.folder}/data/version={r['version']}/part={r['partition']}" for r in newest]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def live(self, version: int | None = None) -> DataFrame:
        return self.rows(version).where(F.col("deleted_at").isNull()).drop("deleted_at")

    def _step(self, epoch: str, kind: str, changes: DataFrame, change, also: list[int] | None = None) -> int:
        """Rewrites the partitions of ``changes`` (and others named) by ``change(old rows, changes)``."""
        taken = self.log().where(F.col("epoch") == epoch).agg(F.min("version")).first()[0]
        if taken is not None:
            return taken
        new = self.version() + 1
        touched = sorted({r[0] for r in changes.select(self.partition).distinct().collect()} | set(also or []))
        made = change(self.rows(partitions=touched), changes).select(self.schema.fieldNames())
        made.withColumn("part", F.col(self.partition)).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/data/version={new}")
        known = {r[0] for r in self.log().select("partition").distinct().collect()} | {r[0] for r in changes.select(self.partition).distinct().collect()}
        log = [(new, epoch, p, kind) for p in touched if p in known] or [(new, epoch, None, kind)]
        self.spark.createDataFrame(log, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/log/{new}")
        return new

    def merge(self, rows: DataFrame, epoch: str, order: Column | None = None) -> int:
        """Insert or update by key: given values replace old ones, null ones leave them, and a tombstone comes back to life.

        Of several rows of one key the first by ``order`` counts.
        """
        fields = [c for c in self.schema.fieldNames() if c != "deleted_at"]
        rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in fields))
        first = F.row_number().over(Window.partitionBy(self.partition, self.key).orderBy(order if order is not None else F.lit(0)))
        unique = rows.withColumn("__n", first).where("__n = 1").drop("__n")

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            keys = [self.partition, self.key]
            o, n = (df.select(*keys, *(F.col(c).alias(f"{side}{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"{side}here")) for df, side in ((old, "o_"), (new, "n_")))
            both = o.join(n, keys, "full_outer")
            values = [F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in fields if c not in keys]
            return both.select(*keys, *values, F.when(F.col("n_here").isNull(), F.col("o_deleted_at")).alias("deleted_at"))

        return self._step(epoch, "merge", unique, change)

    def tombstone(self, ids: DataFrame, epoch: str, at: Column) -> int:
        """Rows of these keys (and partitions) deleted softly; those that are deleted already keep their time."""
        keys = ids.select(self.partition, self.key).distinct()

        def change(old: DataFrame, gone: DataFrame) -> DataFrame:
            marked = old.join(gone.withColumn("__gone", F.lit(True)), [self.partition, self.key], "left")
            return marked.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("__gone"), at.cast("timestamp"))))

        return self._step(epoch, "tombstone", keys, change)

    def replace(self, rows: DataFrame, epoch: str, at: Column, partitions: list[int] | None = None) -> int:
        """Partitions after they have been processed again: what the new rows name is theirs, all else in them is a tombstone.

        ``partitions`` names those too in which nothing was found this time.
        """
        fields = [c for c in self.schema.fieldNames() if c != "deleted_at"]

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = old.join(new.select(self.partition, self.key), [self.partition, self.key], "left_anti").withColumn("deleted_at", F.coalesce("deleted_at", at.cast("timestamp")))
            return rest.unionByName(new.select(*fields).withColumn("deleted_at", F.lit(None).cast("timestamp")))

        return self._step(epoch, "replace", rows.dropDuplicates([self.partition, self.key]), change, partitions)
