"""Ask as a stream: questions arrive as files, answers are written per micro-batch.

The original application answers one question per form submit. Here the
question table is a Structured Streaming file source; every micro-batch runs
the batch ``ask`` plan (P1) against the incident corpus and writes the answers
to ``sink/epoch=<id>`` with overwrite, so a retried epoch replaces its own
output instead of duplicating it. The checkpoint folder must be shared storage
(the cluster's checkpoint location).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, FloatType, StructField

from ..plans.ask import ask
from ..settings import DEFAULT, Settings
from ..sources.incidents import QUESTION_SCHEMA


def start_ask_stream(spark: SparkSession, incidents: DataFrame, question_dir: str, sink: str,
                     checkpoint: str, settings: Settings = DEFAULT, fmt: str = "json",
                     with_vectors: bool = False, available_now: bool = True, model=None) -> StreamingQuery:
    """Start the stream. ``question_dir`` holds question files (``fmt``) with the
    columns of ``QUESTION_SCHEMA`` (plus ``embedding`` when ``with_vectors``; without,
    ``model`` is the one that embedded the corpus)."""
    if not with_vectors and model is None:
        raise ValueError("questions without vectors need the model that embedded the corpus")
    schema = QUESTION_SCHEMA
    if with_vectors:
        schema = schema.add(StructField("embedding", ArrayType(FloatType()), True))
    questions = spark.readStream.schema(schema).format(fmt).load(question_dir)

    def answer_batch(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        out = ask(incidents, batch, settings, model=model)
        (out["answers"].withColumn("epoch", F.lit(epoch_id))
         .write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch_id}")))

    writer = questions.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
