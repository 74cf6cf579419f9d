"""Briefing packs that are published as a whole, and quantile sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import stats
from aerolens.sources.sinks import drop_old_bundles, read_bundle, write_bundle


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_reader_never_sees_half_a_pack(spark, tmp_path, fmt):
    path = str(tmp_path / "pack")
    one, two = (spark.range(n).select(F.col("id").alias("x")) for n in (3, 5))
    schemas = {"a": "x bigint", "b": "x bigint"}
    with pytest.raises(FileNotFoundError):
        read_bundle(spark, path)
    write_bundle({"a": one, "b": two}, path, fmt)
    opened = read_bundle(spark, path, schemas)
    fails = two.select((F.lit(1) / F.raise_error(F.lit("second table")).cast("int")).alias("x"))
    with pytest.raises(Exception, match="second table"):
        write_bundle({"a": two, "b": fails}, path, fmt)
    again = read_bundle(spark, path, schemas)
    assert {n: d.count() for n, d in again.items()} == {"a": 3, "b": 5}
    assert len([p for p in (tmp_path / "pack").iterdir() if p.name.startswith("pack-")]) == 1  # nothing of the failed one is left
    write_bundle({"a": two}, path, fmt)
    assert {n: d.count() for n, d in read_bundle(spark, path, schemas).items()} == {"a": 5}
    assert opened["b"].count() == 5  # who has opened the old pack still reads it
    drop_old_bundles(spark, path)
    assert len([p for p in (tmp_path / "pack").iterdir() if p.name.startswith("pack-")]) == 1
    assert read_bundle(spark, path, schemas)["a"].count() == 5


def test_sketches_keep_their_rank_error_and_merge(spark):
    rng = np.random.default_rng(4)
    values = {"even": rng.integers(0, 100, 30_000).astype(float), "skewed": rng.lognormal(0, 3, 30_000), "one": np.full(500, 7.0)}
    rows = [(g, float(v), i % 5) for g, vs in values.items() for i, v in enumerate(vs)] + [("none", None, 0), ("none", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, x double, part int").repartition(6)
    whole = stats.quantile_sketches(df, "x", ["g"])
    merged = stats.merge_sketches(stats.quantile_sketches(df, "x", ["g", "part"]), ["g"])
    for sketches in (whole, merged):
        for q in (0.5, 0.9):
            for r in stats.sketch_quantile(sketches, q).collect():
                if r.g == "none":
                    assert r.n == 0 and r.median is None
                    continue
                vs = np.sort(values[r.g])
                low, high = np.searchsorted(vs, r.median, "left") / len(vs), np.searchsorted(vs, r.median, "right") / len(vs)
                assert r.n == len(vs) and low - 2 * stats.sketch_error() <= q <= high + 2 * stats.sketch_error()
    assert stats.sketch_error(4096) < stats.sketch_error(1024) < 0.005
    size = whole.where("g = 'skewed'").select(F.octet_length("sketch")).first()[0]
    assert size < 40_000
