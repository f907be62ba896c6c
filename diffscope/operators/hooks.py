"""Hooks for models and services that the user brings: batched scoring on executors and an external reviewer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from diffscope.functions import review_text as R


def score_batches(df: DataFrame, make_predict_fn: Callable, inputs: list[str], output: str, return_type: str = "double",
                  batch_size: int = 256) -> DataFrame:
    """Add a column predicted by a user model.

    `make_predict_fn()` runs once per Python worker, loads the model there and returns a function of NumPy batches. The
    result may be a number (score in [0, 1]), a string (generated comment or code) or an array, by `return_type`.
    """
    predict = predict_batch_udf(make_predict_fn, return_type=_parse_datatype_string(return_type), batch_size=batch_size)
    return df.withColumn(output, predict(*[F.col(c) for c in inputs]))


def predict_arrays(make_predict_fn: Callable, width: int, return_type: str = "double", batch_size: int = 256):
    """The same hook as a column function over one ARRAY column of fixed width (embeddings, token ids)."""
    return predict_batch_udf(make_predict_fn, return_type=_parse_datatype_string(return_type), batch_size=batch_size,
                             input_tensor_shapes=[[width]])


def external_review(df: DataFrame, client_factory: Callable[[], Callable[[str], str]], prompt: str = "prompt",
                    output: str = "answer_text") -> DataFrame:
    """Ask an external reviewer about each row's prompt (null prompts are skipped).

    `client_factory()` runs once per task and returns prompt -> answer text. A failed request yields a JSON error text,
    so that one bad answer never fails the job. Retries and rate limits belong to the client.
    """
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for frame in frames:
            answers = []
            for text in frame[prompt]:
                if text is None:
                    answers.append(None)
                    continue
                try:
                    answers.append(client(text))
                except Exception as error:  # noqa: BLE001 - the error becomes data
                    answers.append(json.dumps({"error": f"Request failed: {error}"}))
            frame[output] = answers
            yield frame

    schema = StructType([*df.schema.fields, StructField(output, StringType())])
    return df.mapInPandas(ask, schema)


def with_prompt(hunks: DataFrame, output: str = "prompt") -> DataFrame:
    """Add the reviewer's prompt to hunks that changed anything, else null."""
    added, removed = F.array_join("added_lines", "\n"), F.array_join("removed_lines", "\n")
    prompt = R.review_prompt(F.col("file_path"), removed, added, F.array_join("context_lines", "\n"))
    return hunks.withColumn(output, F.when(R.reviewable(added, removed), prompt))
