"""Operator 6, BPE encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, merge_ranks, numbered, vocabulary
from .common import Kept, map_arrow, passes, table

#: Text bytes whose words are encoded together.
PART_BYTES = 1 << 19


def fragments(vocab: Vocabulary, pre_tokens: list[bytes]) -> tuple[list[tuple[bytes, bool]], np.ndarray]:
    """The pre-tokens cut between each two bytes that stand side by side in no token of the vocabulary.

    No merge can join across such a cut, as its product would be a token that holds the pair. Returns the
    fragments, each with whether it ends its pre-token, and the number of fragments of each pre-token.
    """
    joined = b"".join(pre_tokens)
    raw = np.frombuffer(joined, np.uint8)
    stops = np.cumsum(np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens)))
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = ~vocab.inside[raw[:-1], raw[1:]]
    cut[stops] = True
    bounds = np.flatnonzero(cut)
    last = np.zeros(len(raw) + 1, bool)
    last[stops] = True
    last = last[bounds]
    bounds = bounds.tolist()
    own = [(joined[a:b], x) for a, b, x in zip([0, *bounds], bounds, last.tolist(), strict=False)]
    return own, np.diff(np.r_[-1, np.flatnonzero(last)])


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of the runs that begin at starts, one after another."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def encode_words(vocab: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids (int32) of each word: its fragments are encoded on their own, then put together."""
    if not words:
        return []
    pieces, sizes = vocab.pre_tokens(words)
    own, at = numbered(pieces)
    if not own:
        return [b""] * len(words)
    parts, per_piece = fragments(vocab, [p.encode() for p in own])
    distinct, which = numbered(parts)
    sym, lens = vocab.symbols([p for p, _ in distinct], np.fromiter((x for _, x in distinct), bool, len(distinct)))
    tokens, left = merge_ranks(vocab, sym, lens)
    fragment = which[spans((np.cumsum(per_piece) - per_piece)[at], per_piece[at])]
    ids = tokens[spans((np.cumsum(left) - left)[fragment], left[fragment])].astype(np.int32).tobytes()
    ends = 4 * np.r_[0, np.cumsum(left[fragment])][np.r_[0, np.cumsum(per_piece[at])][np.r_[0, np.cumsum(sizes)]]]
    ends = ends.tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decoded: bool = True) -> DataFrame:
    """Every whole text as BPE ids: id_col, n_tokens, ids (array<int>), decoded (text; not without decoded). No shuffle.

    With digests, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 stand for the two.
    A null text counts as empty and gives no ids; null ids and repeated rows stay, row by row; other
    columns are not read; a table without rows gives none. Special strings inside a text are one id each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kept = Kept()

    def one(batch: pa.RecordBatch):
        vocab = vocabulary(vocab_path)
        for part in passes(batch, "text", PART_BYTES):
            texts = []
            for text in part.column("text").to_pylist():
                words: list[str | int] = []
                for x in vocab.segments(text or ""):
                    words += [x] if isinstance(x, int) else vocab.split_words(x)
                texts.append(words)
            distinct = {w for w in set().union(*texts) if isinstance(w, str)}
            known = kept.of(distinct, lambda new: encode_words(vocab, new))
            known.update({i: np.int32(i).tobytes() for i in vocab.special.values()})
            rows = [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in texts]
            columns = [part.column("id"), pa.array([len(r) for r in rows], pa.int64())]
            if digests:
                columns.append(pa.array([hashlib.sha256(" ".join(map(vocab.number.__getitem__, r.tolist())).encode()).hexdigest() for r in rows]))
            else:
                ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows), pa.int32())))
            if decoded:
                names_of = (" ".join(map(vocab.name.__getitem__, r.tolist())) for r in rows)
                columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if digests else x for x in names_of], pa.string()))
            yield pa.record_batch(columns, names)

    kinds = {"id": kind, "n_tokens": "long"} | ({"ids_sha256": "string"} if digests else {"ids": "array<int>"})
    if decoded:
        kinds["decoded_sha256" if digests else "decoded"] = "string"
    names = list(kinds)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(own, ", ".join(f"{c} {t}" for c, t in kinds.items()), one).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col, the names of its ids joined by a space: the file names no decoder.

    Null ids give null. A JVM-side lookup in the vocabulary's own array, whose size is fixed by the file.
    """
    names = F.array(*[F.lit(x) for x in vocabulary(vocab_path).name])
    return encoded.withColumn(out_col, F.array_join(F.transform(ids_col, lambda i: F.get(names, i)), " "))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
