"""Similarity search, probes and the sweep sample.

Exact cosine top-k. Up to ``Settings.question_block`` question (or probe) vectors are
sent to the tasks, where every Arrow batch of the corpus is multiplied by them in
NumPy and a running per-question top-k (ties included) is kept per partition. Only
(question, id, score) leave Python; a first ranking per (question, salt) and a second
per question merge the candidates, and the incidents' columns are joined back to the
k survivors. More questions are joined with an index of vector groups
(``vector_index``). No (question x incident) table exists.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialise
from ..settings import DEFAULT, Settings
from .vector_index import VectorIndex, build_index, top_k

#: Sub-keys per question of the first ranking.
SALTS = 64
#: Corpus rows multiplied at once.
ROWS = 4096


def _scores(src: DataFrame, ids: list, questions: np.ndarray, k: int, settings: Settings) -> DataFrame:
    """(question_id, id, raw): each partition's candidates for one block of questions.
    ``src``: (id, vector) with vectors of the questions' width."""
    norms = np.linalg.norm(questions, axis=1)
    norms[norms == 0] = np.nan
    block = src.sparkSession.sparkContext.broadcast((questions / norms[:, None]).T.copy())
    width, digits, score_min = questions.shape[1], settings.rank_digits, settings.score_min
    id_type = src.schema[0].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qt = block.value
        n_q = qt.shape[1]
        q_idx, q_score, found = np.empty(0, np.int64), np.empty(0), None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                vn = np.linalg.norm(v, axis=1)
                vn[vn == 0] = np.nan
                sims = np.round((v @ qt) / vn[:, None], digits)  # rows x questions
                ok = ~np.isnan(sims)
                if score_min is not None:
                    ok &= sims >= score_min
                if len(v) > k:
                    kth = -np.partition(-np.where(ok, sims, -np.inf), k - 1, axis=0)[k - 1]
                    ok &= sims >= kth[None, :]
                r, c = np.nonzero(ok)
                if not len(r):
                    continue
                q_idx, q_score = np.concatenate([q_idx, c]), np.concatenate([q_score, sims[r, c]])
                new = part.column(0).take(pa.array(r))
                found = new if found is None else pa.concat_arrays([found, new])
                order = np.lexsort((-q_score, q_idx))
                q_idx, q_score = q_idx[order], q_score[order]
                pos = np.arange(len(q_idx)) - np.searchsorted(q_idx, q_idx, side="left")
                kth_of = np.full(n_q, -np.inf)
                at_k = pos == k - 1
                kth_of[q_idx[at_k]] = q_score[at_k]
                live = q_score >= kth_of[q_idx]
                q_idx, q_score, found = q_idx[live], q_score[live], found.take(pa.array(order[live]))
        if found is not None:
            names = pa.array(ids, pa.string()).take(pa.array(q_idx))
            yield pa.RecordBatch.from_arrays([names, found, pa.array(q_score)], names=["question_id", "id", "raw"])

    return src.mapInArrow(work, f"question_id string, id {id_type.simpleString()}, raw double")


def similarity_topk(incidents: DataFrame, questions: DataFrame, k: int, id_col: str = "id",
                    vec_col: str = "embedding", q_id: str = "question_id", q_vec: str = "embedding",
                    settings: Settings = DEFAULT, keep_cols: list[str] | None = None, index: VectorIndex | None = None) -> DataFrame:
    """T1 (+J4): the k incidents most similar (cosine) to each question.

    Ranked by score at ``settings.rank_digits`` digits, descending, then ``id_col``
    ascending (``id_col`` is unique); shown with ``settings.score_digits``.
    ``settings.score_min`` (off by default) drops weaker matches before ranking.
    A vector that is null, holds a null or has not the questions' width takes no
    part. Columns: ``question_id``, ``rank``, ``score`` and ``keep_cols`` (default:
    every incident column except the vector). The result is written, so plans
    built on it do not score again.

    Up to ``settings.question_block`` questions are answered by one scan of the corpus.
    More, or any number with an ``index`` of the corpus (``vector_index.build_index``), are
    joined with the index's groups, whatever their number; without an index one is built.
    """
    keep = keep_cols if keep_cols is not None else [c for c in incidents.columns if c != vec_col]
    if id_col not in keep:
        keep = [id_col, *keep]
    asked = questions.select(F.col(q_id).cast("string").alias("question_id"), F.col(q_vec).alias("v"))
    few = asked.limit(settings.question_block + 1).collect() if index is None else []
    if index is None and len(few) <= settings.question_block:
        top = _scan_topk(incidents.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), few, k, settings)
    else:
        if index is None:
            width = asked.agg(F.max(F.size("v"))).first()[0]
            index = build_index(incidents, id_col, vec_col, width=width)
        top = top_k(index, asked, k, settings)
    out = top.withColumnRenamed("id", "_id").join(incidents.select(*keep), F.col("_id") == F.col(id_col))
    return materialise(out.select("question_id", F.round("raw", settings.score_digits).alias("score"), *keep, "rank"), "ranked")


def _scan_topk(src: DataFrame, questions: list, k: int, settings: Settings) -> DataFrame:
    """(question_id, id, raw, rank) by one scan of ``src`` (id, v) for one block of questions."""
    width = max((len(r[1]) for r in questions if r[1] is not None), default=0)
    rows = [r for r in questions if r[1] is not None and len(r[1]) == width and None not in r[1]]
    if not rows:
        return src.select(F.lit("").alias("question_id"), "id", F.lit(0.0).alias("raw"), F.lit(1).alias("rank")).limit(0)
    src = src.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull()))
    cands = _scores(src, [r[0] for r in rows], np.asarray([r[1] for r in rows], dtype=np.float64), k, settings)
    best = [F.desc("raw"), F.asc("id")]
    salted = Window.partitionBy("question_id", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*best)
    first = cands.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k).drop("_r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*best))).where(F.col("rank") <= k)


def random_probes(spark: SparkSession, n: int, dim: int, seed: int = DEFAULT.seed) -> DataFrame:
    """N seeded Gaussian unit vectors (``v / (|v| + 1e-12)``, float32) as ``(probe INT, embedding ARRAY<FLOAT>)``.

    Counter-based: component d of probe p is a Box-Muller draw from two numbers of the MD5 digest of
    ``<seed>:<p>:<d>``, so any task, or SQL, draws the same vectors without those before them.
    """
    def uniform(digest, start):  # the middle of one of 2^52 equal parts of (0, 1)
        return (F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))

    def component(d):
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("probe").cast("string"), d.cast("string")))
        return F.sqrt(-2.0 * F.log(uniform(digest, 1))) * F.cos(2.0 * F.lit(math.pi) * uniform(digest, 14))

    rows = spark.range(n).select(F.col("id").cast("int").alias("probe"))
    rows = rows.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component) if dim else F.array().cast("array<double>"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return rows.withColumn("norm", norm).select("probe", F.transform("v", lambda x: x / F.col("norm")).cast("array<float>").alias("embedding"))


def dedupe_first(df: DataFrame, key, order_cols: list, cols: list[str] | None = None) -> DataFrame:
    """One row per key, the first in ``order_cols`` order.

    ``min_by`` over a struct is a hash aggregate with a map-side partial step,
    so a key holding a third of all rows is reduced before the shuffle.
    """
    cols = cols or df.columns
    key_col = key if not isinstance(key, str) else F.col(key)
    first = F.min_by(F.struct(*cols), F.struct(*order_cols)).alias("_first")
    return df.groupBy(key_col.alias("_key")).agg(first).select("_first.*")


def sweep(incidents: DataFrame, probes: DataFrame, settings: Settings = DEFAULT, id_col: str = "id",
          vec_col: str = "embedding", probe_col: str = "probe") -> DataFrame:
    """For each probe in order its ``sweep_probe_k`` best matches; one row per
    report (``coalesce(report_number, id)``, D11), first seen in (probe, rank)
    order; the first ``sweep_target_max`` of those.

    Probes are taken in rounds, each the fewest that could fill the sample; once it is
    full, later probes are not scored. That changes nothing: a report's place is its
    first (probe, rank), and whatever a later probe finds stands behind all that the
    probes before it have found.
    """
    cap, each = settings.sweep_target_max, settings.sweep_probe_k
    # The number of probes is a parameter; their vectors stay in Spark.
    order, held, done = [r[0] for r in probes.select(F.col(probe_col)).orderBy(probe_col).collect()], None, 0
    while done < len(order):
        known = _first_reports(held, id_col).count() if held is not None else 0
        if known >= cap:
            break  # every later probe ranks behind all that is held
        part = order[done:done + math.ceil((cap - known) / each)]
        done += len(part)
        asked = probes.where(F.col(probe_col).isin(part)).withColumn("question_id", F.col(probe_col).cast("string"))
        top = similarity_topk(incidents, asked, each, id_col=id_col, vec_col=vec_col, q_vec="embedding", settings=settings)
        top = top.withColumn("probe", F.col("question_id").cast("int")).drop("question_id")
        held = top if held is None else held.unionByName(top)
    if held is None:
        held = similarity_topk(incidents, probes.limit(0).withColumn("question_id", F.lit("")), each, id_col=id_col, vec_col=vec_col,
                               settings=settings).withColumn("probe", F.lit(0)).drop("question_id")
    return _first_reports(held, id_col).orderBy("probe", "rank").limit(cap)


def _first_reports(top: DataFrame, id_col: str) -> DataFrame:
    """One row per report, the first in (probe, rank) order."""
    own = F.col(id_col).cast("string")
    report = F.coalesce(F.col("report_number").cast("string"), own) if "report_number" in top.columns else own
    return dedupe_first(top, report, ["probe", "rank"])


def _bucketed(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """``_tok``: every token of the text as the name of its bucket, the first 52 bits of its MD5 modulo ``dim``."""
    from ..functions.text import tokens

    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 13), 16, 10).cast("long") % dim).cast("string")
    return df.withColumn("_tok", F.transform(tokens(text_col), bucket))


def _counter(dim: int):
    from pyspark.ml.feature import CountVectorizerModel

    return CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_tok", outputCol="_tf")


def count_terms(corpus: DataFrame, text_col: str, dim: int) -> DataFrame:
    """The corpus with ``_tf`` (each text's tokens counted by bucket) instead of the text, written: ``fit_embedder`` and
    ``embed`` take the counts from there, so the texts are read once."""
    counted = _counter(dim).transform(_bucketed(corpus, text_col, dim).drop(text_col))
    return materialise(counted.drop("_tok"), "term-counts")


def fit_embedder(corpus: DataFrame, text_col: str, dim: int):
    """MD5 buckets of tokens -> term frequencies -> IDF ``ln((1 + n) / (1 + df))`` -> L2 norm, fitted on the corpus's
    texts (or their ``count_terms``). One model embeds the corpus and the questions, so their vectors can be compared."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF, Normalizer

    counts = _counter(dim)
    counted = corpus if "_tf" in corpus.columns else counts.transform(_bucketed(corpus, text_col, dim).select("_tok"))
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted.select("_tf"))
    return PipelineModel([counts, idf, Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)])


def embed(df: DataFrame, text_col: str, dim: int | None = None, out_col: str = "embedding", fn=None, model=None) -> DataFrame:
    """Text (or its ``count_terms``) to a unit vector.

    ``model`` is what ``fit_embedder`` gave for the corpus (all MLlib on the JVM). ``fn`` (a
    function from a list of texts to a list of vectors, e.g. a local model) runs in an
    iterator pandas UDF so it is set up once per task, not per row.
    """
    if fn is not None:
        from pyspark.sql.functions import pandas_udf

        @pandas_udf("array<float>")
        def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([list(map(float, v)) for v in fn(s.fillna("").tolist())])

        return df.withColumn(out_col, _embed(F.col(text_col)))
    if model is None:
        raise ValueError("embed needs the model that embedded the corpus (fit_embedder) or a function")
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    if "_tf" in df.columns:
        df, model = df.withColumn("_tok", F.lit(None)), PipelineModel(model.stages[1:])
    else:
        df = _bucketed(df, text_col, len(model.stages[0].vocabulary))
    return (model.transform(df).withColumn(out_col, vector_to_array("_vec", "float32"))
            .drop("_tok", "_tf", "_idf", "_vec"))
