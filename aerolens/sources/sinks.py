"""Sink (S4): write a briefing pack, published as a whole."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file that names the published tables of a pack.
MANIFEST = "manifest.json"


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each table in ``fmt`` (parquet, json, csv, orc) to a new folder below ``path``, then publish them together.

    Each table is written by its own job straight from the executors; nothing is
    gathered on the driver. Only when all are written is ``manifest.json`` put in place, by a
    rename: a reader that follows it (``read_bundle``) sees the whole new pack or the whole one
    before, whatever fails in between. The folders of an attempt that fails are removed; those of earlier packs stay for
    readers that have opened them (``drop_old_bundles``). CSV cannot hold nested columns, so those are stored as JSON text.
    """
    if not tables:
        raise ValueError("a pack needs a table")
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex[:12]
    folder = os.path.join(path, f"pack-{version}")
    out = {name: os.path.join(folder, name) for name in tables}
    try:
        for name, df in tables.items():
            _write(df, out[name], fmt)
    except Exception:
        _delete(spark, folder)
        raise
    _publish(spark, path, {"version": version, "format": fmt, "tables": {n: f"pack-{version}/{n}" for n in tables}})
    return out


def read_bundle(spark: SparkSession, path: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """The tables of the published pack. ``schemas`` gives those that the format does not hold (json, csv)."""
    found = _manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no pack is published in {path}")
    read = {}
    for name, at in found["tables"].items():
        reader = spark.read.format(found["format"]).option("header", "true")
        reader = reader.schema(schemas[name]) if schemas and name in schemas else reader
        read[name] = reader.load(os.path.join(path, at))
    return read


def drop_old_bundles(spark: SparkSession, path: str) -> None:
    """Remove the folders of packs that are not the published one."""
    found, (fs, where) = _manifest(spark, path), _fs(spark, path)
    for at in fs.listStatus(where):
        name = at.getPath().getName()
        if name.startswith("pack-") and (found is None or name != f"pack-{found['version']}"):
            fs.delete(at.getPath(), True)


def _write(df: DataFrame, target: str, fmt: str) -> None:
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, MapType, StructType

    if fmt == "csv":
        df = df.select(*[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ])
        df.write.option("header", "true").csv(target)
    else:
        df.write.format(fmt).save(target)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, os.path.join(path, MANIFEST))
    if not fs.exists(at):
        return None
    rows = spark.read.text(os.path.join(path, MANIFEST), wholetext=True).collect()  # one small file
    return json.loads(rows[0].value)


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    fs, new = _fs(spark, os.path.join(path, f"_{manifest['version']}.json"))
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options
    overwrite = spark.sparkContext._gateway.new_array(options.Rename, 1)
    overwrite[0] = options.Rename.OVERWRITE
    context.rename(new, spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, MANIFEST)), overwrite)
