"""The two places where a model comes in: embedding texts and completing prompts.

Both are functions of a batch that are made once a task, so that a model is loaded once; answers that were recorded are
joined instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Complete = Callable[[list[str]], list[str]]


def embedded(rows: DataFrame, id_col: str, text_col: str, make: Callable[[], Embed], model: str) -> DataFrame:
    """(id, model, vector) of each text; null texts have no vector. ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for batch in batches:
            vectors = embed(batch.column("text").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vector"])

    kind = dict(rows.dtypes)[id_col]
    out = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").mapInArrow(run, f"id {kind}, vector array<double>")
    return out.select("id", F.lit(model).alias("model"), "vector")


def completed(prompts: DataFrame, make: Callable[[], Complete]) -> DataFrame:
    """(id, prompt, answer) of each prompt. prompts: id, prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete = make()
        for batch in batches:
            answers = complete(batch.column("prompt").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("prompt"), pa.array(answers, pa.string())], names=["id", "prompt", "answer"])

    kind = dict(prompts.dtypes)["id"]
    return prompts.select("id", "prompt").mapInArrow(run, f"id {kind}, prompt string, answer string")


def recorded(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """The same from a table of recorded answers: the last by seq for each id, null where there is none."""
    last = answers.groupBy("id").agg(F.max_by("answer", "seq").alias("answer"))
    return prompts.join(last, "id", "left").select("id", "prompt", "answer")
