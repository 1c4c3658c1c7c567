"""Session settings, shared-folder materialisation and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 200_000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def compiled_methods(spark: SparkSession) -> None:
    """Lets Spark cut generated code that fuses so many text expressions that the JVM would only interpret it: HotSpot compiles no
    method above 8,000 bytes of bytecode. A limit that the session was given stays."""
    if spark.conf.get(_METHOD_LIMIT) == "65535":  # the default
        spark.conf.set(_METHOD_LIMIT, "8000")


def get_session(app: str = "cropledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one is made up only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cropledger-")
    sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors. What the write shuffled goes as it ends,
    and not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Empty a written intermediate table that nothing reads any more. The empty frame is not made from a Python list, for which
    executors would start Python workers."""
    files = df.inputFiles()
    if files:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        df.sparkSession.range(0, 0, 1, 1).select(*none).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table that is read many times, dealt evenly into as many partitions as fill the cores in whole rounds, or into
    ``most`` where that is less."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    parts = cores * max(1, round(parts / cores))
    return df.repartition(parts if most is None else max(1, min(parts, most)))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised table after counting it; beyond the limit leave the join to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
