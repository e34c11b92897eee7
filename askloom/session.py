"""Sessions, shared folders and small helpers which every operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def get_spark(name: str = "askloom", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster the caller brings its own session."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and name a checkpoint folder where the session has none."""
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a session without one that runs in one process (tests, a laptop) gets a
    temporary folder; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and on_cluster(spark):
        raise ValueError("spark.checkpoint.dir names no folder which all executors share")
    named = named or tempfile.mkdtemp(prefix="askloom-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write the rows to the shared folder and go on from there: lineage ends and lost executors cost nothing. With `free`
    the shuffles that led here are removed at once, which Spark else leaves until its driver collects garbage."""
    shared_folder(df.sparkSession)
    if not free:
        return df.checkpoint(eager=True)
    with _freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under this setting


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside remove their shuffles when they end."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """What `cut` gives, as Parquet: compressed, so that long rows take a fraction of a checkpoint's disk. The shuffles
    that led here are removed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _freeing(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str = "Id") -> DataFrame:
    """Rows with a key, repeated rows counted once. Rows whose key is null have no identity and leave."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def once_wide(df: DataFrame, key: str = "Id", most_sent: int = 1_000_000) -> DataFrame:
    """What `once` gives, of a scan of files with long columns, which are not shuffled: keys alone are counted, and of the
    rows of a key that stands more than once the first by file and place stays. Keys that repeat are broadcast while
    they are at most `most_sent` (32 bytes each), else joined."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = df.where(F.col(key).isNotNull()).select(*df.columns, place.alias("_place"))
    keys = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    repeated = cut(keys.where("_n > 1").select("_key", "_first"))
    n = repeated.count()
    if not n:
        return rows.drop("_place")
    sent = F.broadcast(repeated) if n <= most_sent else repeated
    kept = rows.join(sent, F.col(key) == F.col("_key"), "left").where("_key is null or _place = _first")
    return kept.select(*df.columns)


def on_cluster(spark: SparkSession) -> bool:
    """Whether executors may run on other machines, so that a folder of this one is of no use to them."""
    return not spark.sparkContext.master.startswith("local")
