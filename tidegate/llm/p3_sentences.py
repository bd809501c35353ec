"""Problem 3: every document as sentence units. The automaton is in sentences.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.sentences import sentence_spans


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def sentence_units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spans of a text's sentence units; null for null, none for blank."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in sentence_spans(t)])


_UNITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("unit", T.StringType())]))


@F.pandas_udf(_UNITS)
def sentence_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """sentence_units with the text of each unit, so that no row of a unit has to carry the document."""
    for texts in batches:
        yield texts.map(lambda t: None if t is None else [{"start": a, "end": b, "unit": t[a:b]} for a, b in sentence_spans(t)])


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, sentence_no, start_character, end_character) per sentence unit of each row's text.

    Rows whose text is null or blank give no row. Equal rows give equal units each; make keys unique first where a
    document may be delivered again. No shuffle: a scan, the automaton, an explode.
    """
    spans = df.select(F.col(key).alias("_key"), sentence_units(F.col(text)).alias("_spans"))
    return spans.select(F.col("_key").alias(key), F.posexplode("_spans").alias("_no", "_span")).select(key, (F.col("_no") + 1).alias("sentence_no"), F.col("_span.start").alias("start_character"), F.col("_span.end").alias("end_character"))


def once_per_key(df: DataFrame, key: str, columns: list[str], newest_by: str) -> DataFrame:
    """The latest delivery of each key. Rows without a key are left out: they name no document.

    Aggregated in part before the one shuffle; ties on newest_by are broken by the columns, so the result is fixed.
    """
    latest = F.max(F.struct(F.coalesce(F.col(newest_by), F.lit(0).cast("timestamp")).alias("_at"), *columns)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(latest).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
