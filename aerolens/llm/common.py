"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word, everywhere in this subpackage unless an operator says otherwise: a
#: run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: ``documents`` as the tables have it.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body (or a lambda in it) mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(doc_id: Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod mod``; a null id falls into fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def hex_fraction(digest: Column) -> Column:
    """The first 13 hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


#: Texts handed to a Python worker at once, and those it works on at once, in bytes.
ARROW_BATCH_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes (not only the rows) that Spark sends to Python at once, unless the session does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)) or 2**31 - 1) >= 2**31 - 1:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def map_texts(docs: DataFrame, text_col: str, fields: str, factory: Callable[[], Callable]) -> DataFrame:
    """``docs`` with the columns ``fields`` (a DDL string), computed from its texts in Python.

    ``factory()`` runs once a task and gives a function from a list of texts (null: empty) to one
    list of values (or Arrow array of the column's type) per new column. It is called with blocks of at most ``BLOCK_BYTES`` of text (or
    one longer text), so memory does not follow the batch size. New columns replace old ones of
    the same name.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    bound_batches(spark)
    new = StructType.fromDDL(fields)
    docs = docs.drop(*[f.name for f in new.fields if f.name != text_col])
    types = [f.type for f in to_arrow_schema(new)]
    names = [f.name for f in new.fields]
    at, block = docs.columns.index(text_col), BLOCK_BYTES

    def work(batches):
        fn = factory()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            start, held = 0, 0
            for i in range(batch.num_rows + 1):
                size = len(texts[i].as_py() or b"") if i < batch.num_rows else 0
                if i == batch.num_rows or (held and held + size > block):
                    if i > start:
                        some = [(t or b"").decode("utf-8", "replace") for t in texts[start:i].to_pylist()]
                        cols = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(fn(some), types)]
                        rows = batch.slice(start, i - start)
                        yield pa.RecordBatch.from_arrays([*rows.columns, *cols], names=[*rows.schema.names, *names])
                    start, held = i, 0
                held += size
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *new.fields]))


def bounded_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` distinct keys' rows, the same ones whenever the rows are the same: those
    whose keys hash lowest. Only ``n`` hashes are ordered; nothing else is moved."""
    rank = F.xxhash64(F.lit("sample"), key)
    edge = rows.select(rank.alias("r")).distinct().orderBy("r").limit(n).agg(F.max("r")).first()[0]
    return rows.where(rank <= F.lit(edge)) if edge is not None else rows.limit(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, n: int,
                    max_chars: int) -> list[tuple[str, int]]:
    """At most ``n`` labelled texts of at most ``max_chars`` characters, with their labels (0 or 1),
    ordered by id. The labels are sampled first, so only ``n`` rows are broadcast and of each id
    only its smallest text is kept. A document with both labels counts as 1."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    some = bounded_sample(known, F.col("_id"), n).groupBy("_id").agg(F.max("_label").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")) \
        .where(F.length("_text") <= max_chars).join(F.broadcast(some), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    found = sorted((r._id, r._text, r._label) for r in rows.collect())
    return [(t, y) for _, t, y in found]
