"""Problem 2: visually identical text with different characters.

Method: confusables skeleton. Each original is decomposed, every character replaced by its prototype from the look-alike table (other
alphabets, full-width and joined forms, invisible characters and odd spaces, and look-alikes within ASCII) and decomposed again.
Texts with equal skeletons look the same and are one group (`spellings`). A text in whose skeleton nothing but ASCII was replaced is
consistent as it stands; the others get their consistent form, in which each word's look-alikes are those of its own alphabet, and an
exact comparison tells whether they differ from it.

Cases: a null text gives null skeleton and form and is unchanged; an empty text is its own form; any length works (one pass over
the characters); repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textforms import consistent, has_lookalikes, skeleton


def unify(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, ``skeleton_id`` (64-bit hash of the skeleton), ``form`` (the consistent form), ``changed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bones = [skeleton(t) for t in pdf["text"]]
            form = [consistent(t) if t is not None and has_lookalikes(t, b) else t for t, b in zip(pdf["text"], bones)]
            ids = [None if b is None else xxhash.xxh64_intdigest(b.encode("utf-8", "surrogatepass")) - (1 << 63) for b in bones]
            yield pd.DataFrame({"key": pdf["key"], "text": pdf["text"], "skeleton_id": pd.array(ids, "Int64"), "form": form, "changed": [f != t for f, t in zip(form, pdf["text"])]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "key string, text string, skeleton_id long, form string, changed boolean")


def suspicious(text: str):
    """JVM-side test that spares pure ASCII texts, which are always consistent, the trip to Python."""
    return F.col(text).rlike("[^\\x00-\\x7F]")


def spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of equal skeletons with more than one spelling: numbers of texts, spellings and consistent forms, and the form of most texts.

    Spellings are counted by hash before the shuffle, so a hot group is pre-aggregated and no group is gathered."""
    rows = unify(df, key, text).where("text is not null")
    one = rows.groupBy("skeleton_id", F.xxhash64("text").alias("spelling")).agg(F.count("*").alias("texts"), F.min("form").alias("form"))
    form = one.groupBy("skeleton_id", F.xxhash64("form").alias("f")).agg(F.sum("texts").alias("texts"), F.count("*").alias("spellings"), F.min("form").alias("form"))
    group = form.groupBy("skeleton_id").agg(F.sum("texts").alias("texts"), F.sum("spellings").alias("spellings"), F.count("*").alias("forms"), F.max(F.struct("texts", "form")).alias("top"))
    return group.where("spellings > 1").select("skeleton_id", "texts", "spellings", "forms", F.col("top.form").alias("form"))


def inconsistent(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose text isn't in consistent form, once each."""
    return unify(df.where(suspicious(text)), key, text).where("changed and key is not null").select(F.col("key").alias(key)).distinct()
