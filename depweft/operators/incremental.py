"""Processing only new or changed records, with the target as the only state.

Every output row carries the key and version of the source row it was made from. What is to do is the source minus the
target (anti-join on key and version); there is no watermark or offset file that could run ahead of or lag behind the data.
A run writes its rows into a folder of its own and then publishes a new target version by creating one small manifest
that lists the folders of the version. The manifest appears whole, and only if nobody else has published the same number, by an
operation that refuses to replace a file; so a run which fails at any point leaves the last version in force and the next run
repeats exactly the unpublished rows.

run_once keeps every version of a key that was ever processed. refresh_once is for sources with one row per key: what counts is the
newest row of each key, so that a version that comes back is processed again, and keys that left the source are withdrawn.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Age in seconds from which a folder that no version lists counts as left behind by a run that failed.
ABANDONED_S = 7 * 86_400


def pending(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source that have no row in done with equal keys; nulls in keys are equal to nothing."""
    return source.join(done.select(*keys).distinct(), keys, "left_anti")


def latest_by(df: DataFrame, key: Column, order: list[Column], fields: dict[str, Column], key_name: str = "key") -> DataFrame:
    """The row of each key that is last in order (nulls come first); ties go to the greatest fields, so that the choice does
    not depend on the rows' order. An aggregation with partial sums, hence no trouble with keys of many rows."""
    packed = F.struct(*(c.alias(f"__o{i}") for i, c in enumerate(order)), *(c.alias(n) for n, c in fields.items()))
    best = df.select(key.alias(key_name), packed.alias("__row")).groupBy(key_name).agg(F.max("__row").alias("__row"))
    return best.select(key_name, *(F.col("__row")[n].alias(n) for n in fields))


class VersionedTarget:
    """A table in a shared folder: `parts/<run>` holds Parquet files, `versions/<number>.json` lists the parts of a version."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        """The greatest published number; 0 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/versions"))]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())])

    def parts(self, version: int | None = None) -> list[str]:
        v = self.version() if version is None else version
        if not v:
            return []
        stream = self._fs.open(self._path(f"{self.path}/versions/{v:08d}.json"))
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(data)["parts"]

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def publish(self, rows: DataFrame, based_on: int, replace: bool = False) -> int:
        """Writes rows and makes them, with the parts of version based_on unless replace, the version after it.

        Raises FileExistsError if another run has published that version meanwhile; nothing is visible then, and the caller
        computes what is to do again.
        """
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{part}")
        kept = [] if replace else self.parts(based_on)
        number = based_on + 1
        body = json.dumps({"version": number, "parts": [*kept, part]}).encode()
        draft = f"{self.path}/versions/.{part}.tmp"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(body))
        out.close()
        try:
            self._appear(draft, f"{self.path}/versions/{number:08d}.json")
        except FileExistsError:
            self._fs.delete(self._path(f"{self.path}/parts/{part}"), True)
            raise FileExistsError(f"version {number} was published by another run") from None
        finally:
            self._fs.delete(self._path(draft), False)
        return number

    def _appear(self, draft: str, final: str) -> None:
        """Gives a whole file its final name; FileExistsError if that is taken, decided by the file system in one step.

        Local files get a second name by a hard link, which fails on a taken one. Elsewhere the file context renames without replacing,
        which is one step on HDFS and stores with directories. A store that copies to rename needs one writer at a time.
        """
        if self._fs.getScheme() == "file":
            local = [self._path(p).toUri().getPath() for p in (draft, final)]
            os.link(*local)
            return
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri(), conf).rename(self._path(draft), self._path(final), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(final) from None
            raise

    def runs(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the column run: the place of their part in it, so that later runs have greater numbers."""
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, run int")
        order = self.spark.createDataFrame(list(zip(parts, range(1, len(parts) + 1))), "part string, run int")
        rows = self.read(version).withColumn("part", F.regexp_extract("_metadata.file_path", r"/parts/([0-9a-f]+)/[^/]*$", 1))
        return rows.join(F.broadcast(order), "part").drop("part")

    def current(self, key: str, version: int | None = None) -> DataFrame:
        """The newest row of each key; keys withdrawn since have none. The column gone boolean of the schema marks withdrawals."""
        rows = self.runs(version)
        newest = rows.groupBy(key).agg(F.max(F.struct("run", *(c for c in rows.columns if c not in (key, "run")))).alias("r"))
        return newest.select(key, *(f"r.{c}" for c in rows.columns if c not in (key, "run"))).where(~F.coalesce("gone", F.lit(False)))

    def clean(self, older_than_s: float = ABANDONED_S) -> list[str]:
        """Deletes the part folders that no version lists and that are older than given, and names them: what failed runs left."""
        listed = {p for s in self._fs.listStatus(self._path(f"{self.path}/versions")) if s.getPath().getName().endswith(".json") for p in self.parts(int(s.getPath().getName()[:-5]))}
        folder = self._path(f"{self.path}/parts")
        left = [s.getPath() for s in (self._fs.listStatus(folder) if self._fs.exists(folder) else []) if s.getPath().getName() not in listed and s.getModificationTime() / 1000 <= time.time() - older_than_s]
        for p in left:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in left)


def run_once(source: DataFrame, target: VersionedTarget, keys: list[str], process) -> tuple[int, DataFrame]:
    """One run: rows of source that the target does not hold are processed and published; process keeps the keys."""
    based_on = target.version()
    todo = pending(source, target.read(based_on), keys)
    number = target.publish(process(todo), based_on)
    return number, target.read(number)


def refresh_once(source: DataFrame, target: VersionedTarget, key: str, version: str, process) -> tuple[int, DataFrame]:
    """One run over a source with one row per key: new and changed rows are processed, keys that left the source withdrawn, and both
    published as one version; the number of that version and the newest rows.

    process keeps key and version. A version that was there before and comes back is processed again, as the newest row of its key is
    another one. Rows without key are no records; a null version is a version like any other.
    """
    based_on = target.version()
    now = target.current(key, based_on).select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    own = source.where(F.col(key).isNotNull())
    todo = own.join(now, (F.col(key) == F.col("__k")) & F.col(version).eqNullSafe(F.col("__v")), "left_anti")
    made = process(todo).withColumn("gone", F.lit(False))
    left = now.join(own.select(F.col(key).alias("__k")), "__k", "left_anti").select(F.col("__k").alias(key), F.col("__v").alias(version), F.lit(True).alias("gone"))
    number = target.publish(made.unionByName(left, allowMissingColumns=True), based_on)
    return number, target.current(key, number)
