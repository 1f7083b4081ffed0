"""Sentence units of documents (p9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.sentence_rules import sentences
from rankforge.runtime import spread


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, start_pos, end_pos): one row per sentence, in code points of the text.

    The language only says whose table is asked first; a missing or wrong one changes little, as every table is asked. Null,
    empty and invisible texts have no sentences. Each text is cut whole, in one pass and without a shuffle.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, starts, ends = [], [], []
            for k, t, l in zip(b["key"].tolist(), b["text"], b["lang"]):
                for a, z in sentences(t if isinstance(t, str) else None, l if isinstance(l, str) else None):
                    keys.append(k)
                    starts.append(a)
                    ends.append(z)
            yield pd.DataFrame({"key": keys, "start_pos": starts, "end_pos": ends})

    small = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return spread(small, "key").mapInPandas(run, f"key {kind}, start_pos int, end_pos int").withColumnRenamed("key", key)


def sentence_texts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, sentence) for the positions given."""
    full = docs.select("doc_id", "text").where("text is not null").join(cuts, "doc_id")
    return full.select("doc_id", "start_pos", "end_pos", F.expr("substring(text, start_pos + 1, end_pos - start_pos)").alias("sentence"))
