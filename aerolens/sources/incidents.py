"""Sources (S1, S2, S3, S5) and the schema boundary."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, DataType, DecimalType, DoubleType, FloatType, MapType, NullType,
                               StringType, StructField, StructType, VariantType)

# Every column an operator may read. Text columns stay text (D2): numbers and
# times are derived next to them, never cast in place.
TEXT_FIELDS = (
    "id", "report_number", "datetime", "flight_phase", "light", "atc_advisory",
    "cause_category", "risk_level", "miss_distance", "altitude",
    "summary_ai", "synopsis", "primary_problem", "full_narrative",
)
CANONICAL_SCHEMA = StructType(
    [StructField(c, StringType(), True) for c in TEXT_FIELDS]
    + [StructField("embedding", ArrayType(FloatType()), True),
       StructField("score", DoubleType(), True)]
)
QUESTION_SCHEMA = StructType([
    StructField("question_id", StringType(), True),
    StructField("question", StringType(), True),
    StructField("date_from", StringType(), True),
    StructField("date_to", StringType(), True),
    StructField("phase", StringType(), True),
])


def conform(df: DataFrame, schema: StructType = CANONICAL_SCHEMA) -> DataFrame:
    """Add each absent column as a typed null, so operators may assume it."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def load_incidents(spark: SparkSession, path: str, fmt: str = "parquet", namespace: str | None = None,
                   namespace_col: str = "namespace", **options) -> DataFrame:
    """Open the corpus. A namespace is a partition column, so the filter prunes files."""
    df = spark.read.format(fmt).options(**options).load(path)
    if namespace is not None:
        df = df.where(F.col(namespace_col) == F.lit(namespace))
    return df


def _map_keys(df: DataFrame, column: str) -> list[str]:
    return sorted(r[0] for r in df.select(F.explode(F.map_keys(column))).distinct().collect())


def _column_type(t: DataType) -> DataType:
    """The column type of a JSON type: fractions as double, text where rows disagree or nothing is known."""
    if isinstance(t, DecimalType):
        return DoubleType()
    if isinstance(t, ArrayType):
        return ArrayType(_column_type(t.elementType))
    if isinstance(t, StructType):
        if not t.fields or len({f.name.lower() for f in t.fields}) < len(t.fields):
            return StringType()
        return StructType([StructField(f.name, _column_type(f.dataType)) for f in t.fields])
    return StringType() if isinstance(t, (NullType, VariantType)) else t


def json_columns(df: DataFrame, column: str) -> StructType:
    """The schema that all JSON objects of ``column`` have together: one mergeable aggregate
    (``schema_of_variant_agg``), of which one row reaches the driver, as wide as the table.

    Objects and lists keep their nesting, whole numbers are bigint, fractions double. A value
    whose type differs between rows, or is null in all, is text (other values as their JSON text).
    Rows that are no JSON object count for nothing.
    """
    # Text that parses is an object if it opens one, so each text is parsed once. What does not parse is null and counts for nothing.
    v = F.when(F.col(column).rlike(r"^[ \t\r\n]*\{"), F.try_parse_json(column))
    text = df.agg(F.schema_of_variant_agg(v)).first()[0]
    if not text.startswith("OBJECT<"):
        return StructType([])
    ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT<", lambda m: "STRUCT<" if m.group() == "OBJECT<" else m.group(), text)
    return StructType([StructField(f.name, _column_type(f.dataType)) for f in DataType.fromDDL(ddl).fields])


def _typed_matches(df: DataFrame, head: list, metadata: str, schema: StructType) -> DataFrame:
    values = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>")
    df = df.withColumn(metadata, values)
    return df.select(*head, *[F.try_variant_get(F.col(metadata).getItem(f.name), "$", f.dataType.simpleString()).alias(f.name)
                              for f in schema.fields])


def flatten_matches(df: DataFrame, metadata: str = "metadata", keys: list[str] | None = None,
                    json_schema: StructType | None = None, typed: bool = False) -> DataFrame:
    """One row per match: ``match_id``, ``score`` and every metadata key.

    ``metadata`` may be a struct, a map or JSON text. Unless ``keys`` (or, for JSON, ``json_schema``)
    is given, the columns are the canonical fields (for JSON) and the union of the keys of all
    rows: one distinct over the keys, whose number is the table's width. An absent key is null;
    JSON values that are not text are given as their JSON text; with ``typed=True`` keys other than
    the canonical fields keep their type and nesting (``json_columns``).
    """
    head = [F.col("id").cast("string").alias("match_id"), F.col("score").cast("double").alias("score")]
    dtype = df.schema[metadata].dataType
    if isinstance(dtype, StringType):
        if json_schema is not None:
            parsed = F.from_json(F.col(metadata), json_schema)
            return df.select(*head, *[parsed[f.name].alias(f.name) for f in json_schema.fields])
        known = [c for c in TEXT_FIELDS if c != "id"]
        if typed:
            found = {f.name: f.dataType for f in json_columns(df, metadata).fields}
            names = keys if keys is not None else [*known, *sorted(k for k in found if k not in (*known, "id", "match_id", "score"))]
            return _typed_matches(df, head, metadata, StructType(
                [StructField(k, StringType() if k in known else found.get(k, StringType())) for k in names]))
        df = df.withColumn(metadata, F.from_json(F.col(metadata), MapType(StringType(), StringType())))
        keys = keys if keys is not None else [*known, *[k for k in _map_keys(df, metadata) if k not in (*known, "id", "match_id", "score")]]
        return df.select(*head, *[F.col(metadata).getItem(k).alias(k) for k in keys])
    if isinstance(dtype, MapType):
        if keys is None:
            keys = _map_keys(df, metadata)
        return df.select(*head, *[F.col(metadata).getItem(k).alias(k) for k in keys])
    return df.select(*head, f"{metadata}.*")


def read_incident_csv(spark: SparkSession, path: str, multi_line: bool = False, **options) -> DataFrame:
    """S3: a CSV dump with a header; every column read as text, then conformed. Files are split
    among tasks; ``multi_line=True`` is for cells with line breaks, and reads a file in one task."""
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE").option("inferSchema", "false")
    reader = reader.option("multiLine", str(multi_line).lower()).option("escape", '"')
    return conform(reader.options(**options).csv(path))


def load_questions(df: DataFrame) -> DataFrame:
    """A table of questions with optional date bounds and phase. Question ids must be
    unique (null counts as one id): results are keyed by them."""
    df = conform(df, QUESTION_SCHEMA)
    if not df.isStreaming:
        twice = df.groupBy("question_id").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"question ids repeat: {', '.join(str(r[0]) for r in twice)}")
    return df.select(*[F.col(f.name).cast("string").alias(f.name) for f in QUESTION_SCHEMA.fields],
                     *[c for c in df.columns if c not in QUESTION_SCHEMA.fieldNames()])
