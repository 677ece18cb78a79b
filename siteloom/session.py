"""Session helpers: recommended settings and lineage cuts."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings for new sessions. Nothing here is needed for right results.
# Arrow batches are kept small because one row holds a whole HTML page.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    # plans here hold long expressions: keep more compiled code, and shorter plan texts for the UI
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.maxPlanStringLength": "8192",
}


def build_session(app: str = "siteloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests, a laptop) is a new temporary folder used.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siteloom-", dir=os.environ.get("TMPDIR"))
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


_built: dict[tuple, object] = {}


def per_session(build):
    """Caches what ``build`` makes of its (hashable) arguments for the life of the Spark context.

    Column expressions are made of many calls into the JVM; those that name their inputs can be
    built once.
    """

    @functools.wraps(build)
    def cached(*args):
        key = (SparkContext._active_spark_context.applicationId, build.__module__, build.__qualname__, args)
        if key not in _built:
            _built[key] = build(*args)
        return _built[key]

    return cached


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, reliably, and cut its lineage.

    It is written as Parquet to a new folder in the shared one, so losing an executor loses nothing and later steps read only
    the columns they use.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def balance(df: DataFrame) -> DataFrame:
    """Spreads a table that has fewer splits than there are cores.

    That is the case only for small inputs; a large one has many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
