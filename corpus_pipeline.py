"""A training-corpus pipeline built from the operators of ``aerolens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents`` (and whatever
further columns the table has).

1. ``language``: texts without any letter, and texts of which no language holds
   ``LEAST_SHARE`` of the letters, are rejected.
2. ``near_duplicates``: one document of each group of near-duplicate texts stays,
   the one with the smallest id (a null id counts as smaller than all). Rows that share an id, null or
   not, are documents of their own unless their texts are near each other.
3. ``personal_data``: confirmed spans are replaced by their kind; the row's
   ``n_chars`` follows the new text.
4. ``mixing``: documents are taken to the target weights of their sources. A row
   is returned as many times as the mix takes its words, rounded, so documents
   that it does not take go and those it repeats come twice.
5. ``tokens``: every document with the ids of its text.

Defined results: nulls and empty texts are treated as each operator says: a
document without text is rejected by the first stage. Empty tables pass through
all stages. Columns of the table that the stages do not know are carried along,
whatever their names; the last stage adds ``n_tokens`` and ``token_ids``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aerolens.llm import bpe, langid, minhash, mixing, pii
from aerolens.llm.queries import vocabulary_path
from aerolens.session import scratch_path

#: A document is rejected if its main language holds less than this share of its letters.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labelled = langid.label(_packed(docs, "text"), model)
    return labelled.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)).select(*_unpacked(docs, text=F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.representatives(docs.select("doc_id", "text"))
    named = _packed(docs, "text", "doc_id").withColumns(minhash.row_name(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(minhash._NULL_ID)), F.coalesce("text", F.lit(""))))
    rows = named.join(kept, ["r1", "r2"])
    single = rows.where("rows = 1").select(*_unpacked(docs, text=F.col("text")))
    # Rows equal in id and text: one of them.
    order = [F.col(f"doc.{c}").asc_nulls_last() for c in ("source", "lang", "n_chars")]
    first = F.row_number().over(Window.partitionBy("r1", "r2").orderBy(*order))
    repeated = rows.where("rows > 1").withColumn("first", first).where("first = 1").select(*_unpacked(docs, text=F.col("text")))
    return single.unionByName(repeated)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = _packed(docs, "text").withColumn("text", pii.mask(F.col("text")))
    size = F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("doc.n_chars"))
    return masked.select(*_unpacked(docs, text=F.col("text"), n_chars=size))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.prepare(_packed(docs, "doc_id", "text", "source"), F.col("doc_id"), F.col("text"), F.array("source"))
    found = mixing.taken(rows, mixing.plan_mix(rows))
    copies = F.round(F.col("taken") / F.col("_mix.size")).cast("int")
    return found.where(F.col("_mix.size") > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*_unpacked(docs, text=F.col("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(docs.drop("token_ids", "n_tokens"), vocabulary_path(), ids_col="token_ids", decoded_col=None)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and all but the text in one column ``doc``, so no column of the table meets an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), *used)


def _unpacked(docs: DataFrame, **new) -> list:
    """The columns of ``docs`` as ``_packed`` has them, but for those in ``new``."""
    return [(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns]


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixing", mix_sources), ("tokens", tokens)]

#: The language stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
