"""The embedding hook: text to vector by hashed terms, or by a function of the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(docs: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, dim: int = 64) -> DataFrame:
    """(doc_id, embedding): unit vectors of hashed words; with `fn`, what it makes of (doc_id, text) batches."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if fn:
        return rows.mapInPandas(fn, "doc_id long, embedding array<float>")
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+").transform(rows)
    terms = HashingTF(inputCol="words", outputCol="terms", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="terms", outputCol="unit").transform(terms)
    return unit.select("doc_id", vector_to_array("unit", "float32").alias("embedding"))
