"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "depweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; settings passed in win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is set (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="depweft-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder: survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows, counted while it is written; a stage that runs again after a loss may count rows twice, so the
    number serves for emptiness and as an upper bound."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for steps that cost far more than moving their rows. An input that comes
    in more splits than that, as any large one does, is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]
