"""Corpus encoding with a public tokenizer (p7), and token counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.byte_bpe import DEFAULT_VOCABULARY, WORDS, ByteBpe, load_ranks
from rankforge.runtime import spread

#: Texts handed to the encoder at once; bounds a task's memory, not what is encoded.
CHUNK = 256
_ENCODER: dict = {}


def _encoder(ranks, vocabulary: str, words: str) -> ByteBpe:
    """One encoder a worker process for a vocabulary and word pattern, so that words met in one batch are known in the next."""
    key = vocabulary, words
    if key not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[key] = ByteBpe(ranks.value, words)
    return _ENCODER[key]


def _mapped(docs: DataFrame, key: str, text: str, vocabulary: str, words: str, count_only: bool) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _encoder(ranks, vocabulary, words)
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                ids = coder.encode_batch([t if isinstance(t, str) else None for t in part["text"]])
                value = {"n_tokens": [len(x) for x in ids]} if count_only else {"ids": ids}
                yield pd.DataFrame({"key": part["key"].to_numpy(), **value})

    small = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = spread(small, "text").mapInPandas(run, f"key {kind}, " + ("n_tokens long" if count_only else "ids array<int>"))
    return out.withColumnRenamed("key", key)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, words: str = WORDS) -> DataFrame:
    """(key, ids): token ids of each row's text, without special tokens; their strings are ordinary text.

    Null and empty texts have an empty list; a text of spaces has the ids of its spaces. Rows with a null key and
    repeated keys are kept as they are. The vocabulary, a file of fixed size, is broadcast; there is no shuffle.
    """
    return _mapped(docs, key, text, vocabulary, words, False)


def token_counts(docs: DataFrame, key: str = "source", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, words: str = WORDS) -> DataFrame:
    """(key, n_tokens) of each row, by the same encoder; 0 for null and empty texts."""
    return _mapped(docs, key, text, vocabulary, words, True)
