"""Operator 8, token counts by rank-synchronous array merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .bpe import merge_ranks, numbered, vocabulary
from .common import Kept, map_arrow, passes, table


def word_counts(vocab, words: list[str]) -> np.ndarray:
    """Tokens of each word: all their pre-tokens, once each, are merged as one ragged array."""
    if not words:
        return np.zeros(0, np.int64)
    pieces, sizes = vocab.pre_tokens(words)
    own, at = numbered(pieces)
    if not own:
        return sizes
    sym, lens = vocab.symbols([p.encode() for p in own], np.ones(len(own), bool))
    _, left = merge_ranks(vocab, sym, lens)
    ends = np.r_[0, np.cumsum(left[at])]
    stops = np.cumsum(sizes)
    return ends[stops] - ends[stops - sizes]


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: id_col, n_bytes (UTF-8), n_tokens. No shuffle.

    A null text counts as empty, an empty one has 0 tokens; null ids and repeated rows stay, row by row;
    other columns are not read. A table without rows gives none. Special strings inside a text
    count as one token each, as the library takes them by default. Memory is bounded by the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kept = Kept()

    def one(batch: pa.RecordBatch):
        vocab = vocabulary(vocab_path)
        n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
        out = []
        for part in passes(batch, "text"):
            texts, more, sizes = [], [], []
            for text in part.column("text").to_pylist():
                words, extra = [], 0
                for x in vocab.segments(text or ""):
                    if isinstance(x, int):
                        extra += 1
                    else:
                        words += vocab.split_words(x)
                texts += words
                sizes.append(len(words))
                more.append(extra)
            known = kept.of(set(texts), lambda new: word_counts(vocab, new).tolist())
            sums = np.r_[0, np.cumsum(np.fromiter(map(known.__getitem__, texts), np.int64, len(texts)))]
            stops = np.cumsum(sizes)
            out.append(sums[stops] - sums[stops - sizes] + more)
        yield pa.record_batch([batch.column("id"), n_bytes, pa.array(np.concatenate(out))], ["id", "n_bytes", "n_tokens"])

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(own, f"id {kind}, n_bytes long, n_tokens long", one).withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", counted["n_tokens"] > 2048)
