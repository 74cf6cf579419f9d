"""Session helpers: one place for configuration and for the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "aerolens", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("AEROLENS_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local session without it (tests)
    gets a private folder; on a cluster a folder of one machine would be lost to
    the others, so its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="aerolens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Scratch folders written by this process, for ``clear_scratch``.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables written so far. Results that still read them must have
    been written or collected before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove the scratch folders that ``df`` is read from, when nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}:
        for path in [p for p in _SCRATCH if os.path.basename(p) == name]:
            _SCRATCH.remove(path)
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage is cut, a lost
    executor loses nothing, later reads prune columns, and nothing stays cached."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of rows sent to Python at once.
ARROW_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes (not only the rows) that Spark sends to Python at once, unless the session does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)) or 2**31 - 1) >= 2**31 - 1:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


@contextlib.contextmanager
def settings_for(spark: SparkSession, **values):
    """Session settings (dots as ``__``) for the jobs inside, given as numbers; smaller ones that are set stay."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, str(min(v, int(before[k])) if before[k].isdigit() else v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def driver_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a table that is read without Python workers (a local relation)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    table = pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=to_arrow_schema(kind))
    return spark.createDataFrame(table, schema=kind)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """``df`` (a scan, possibly projected) dealt to ``partitions`` tasks where its files give fewer; a larger
    table keeps the partitions it has."""
    return df.repartition(partitions) if partitions and df.rdd.getNumPartitions() < partitions else df
