"""Operator 10, removal of word windows that occur more than once, by level-wise doubling.

Windows of WINDOW words are judged through ever longer windows inside them: LEVELS doubles from a quarter of
the length up to it. At a level each window is stood for by that shorter window inside it whose hash is least;
equal windows are stood for by equal ones. Only windows whose stand-in is met at least twice in the corpus
go on to the next level, where windows are twice as long; at the last the windows themselves are counted.
Levels below the last count about 7 and 10 of 100 positions, and each reads only what the one before left.

Hashes are counted by packs (counting.py): no hash, however hot, is a group of rows. Below the last level a hash
that two windows share by chance lets one through that the next level stops; at the last, two hashes of 64 bits
each say that windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting
from .bpe import numbered
from .common import map_arrow, passes, stored, table
from .row_map import RowMap, bit_of, hits, keyed
from .words import GOLD, grams, mixed, raw_texts, widened, word_hashes, word_starts

WINDOW = 35
#: Windows that one pass of the stand-in search works on.
STEP = 1 << 22
#: Text bytes of a pack.
PACK_BYTES = 2 << 20


def levels(window: int) -> list[int]:
    """Lengths, each twice the one before, that end with the window: 9, 18, 35 for 35."""
    out = [window]
    while out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out[-3:]


def hashes_at(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Hashes of the runs of lengths[-1] words, doubled up from those of lengths[0]."""
    h = grams(words, lengths[0])
    for size, to in zip(lengths, lengths[1:], strict=False):
        h = widened(h, size, to)
    return h


def stand_ins(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each window the position of the least of the reach hashes from its start; of equal ones the first."""
    n = len(hashes) - reach + 1
    out = np.zeros(max(0, n), np.int64)
    for start in range(0, n, STEP):
        part = hashes[start : start + STEP + reach - 1]
        key = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < reach:
            key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
        out[start : start + len(key)] = start + (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    return out


def whole_windows(counts: np.ndarray, window: int) -> np.ndarray:
    """Where, in texts of so many words laid end to end, a window lies within one text."""
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    n = max(0, total - window + 1)
    return owner[:n] == owner[window - 1 :] if n else np.zeros(0, bool)


def marks(words: np.ndarray, counts: np.ndarray, lengths: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """What stands for the windows of texts laid end to end (word hashes, words of each): positions of the marks, their
    hashes, a second hash at the last level alone, and for each window its mark (-1 where it spans two texts)."""
    window, none = lengths[-1], np.zeros(0, np.int64)
    whole = whole_windows(counts, window)
    h = hashes_at(words, lengths[: level + 1])
    if level == len(lengths) - 1:
        own = np.flatnonzero(whole)
        second = hashes_at(mixed(words ^ GOLD), lengths)[own] if len(own) else none.astype(np.uint64)
        return own, h[own], second, np.where(whole, np.arange(len(whole)), -1)
    stand = np.where(whole, stand_ins(h, window - lengths[level] + 1), -1) if len(whole) else none
    own = np.unique(stand)
    own = own[own >= 0]
    return own, h[own], None, stand


PACKS = "pack long, k1 array<long>, k2 array<long>, row binary, pos binary, known int, sizes binary, buckets array<int>, asked array<int>, keys array<binary>"
TEXTS = "pack long, k1 array<long>, k2 array<long>, start array<int>, text array<string>, n long"
FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.list_(pa.int32()))])


def first_packs(rows: DataFrame, lengths: list[int], buckets: int) -> DataFrame:
    """The marks of the first level by packs: the row and position of each, and what is asked."""
    wide = len(lengths) == 1

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "text", PACK_BYTES):
            raw, ends = raw_texts(part.column("text"))
            words, counts = word_hashes(raw, ends)
            own, h, second, _ = marks(words, counts, lengths, 0)
            if not len(own):
                continue
            keys = counting.Keys(h, buckets, second if wide else None)
            singles = keys.singles()
            at = own[np.concatenate([singles, keys.others()])]
            stops = np.cumsum(counts)
            row = np.searchsorted(stops, at, side="right")
            k1, k2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            pack = counting.pack_id(k1, k2)
            asked = counting.requests(pack, 0, keys)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "pack": pack, "k1": k1.tolist(), "k2": k2.tolist(), "row": row.astype(np.int32).tobytes(), "pos": (at - (stops - counts)[row]).astype(np.int32).tobytes(),
                        "known": len(at) - len(singles), "sizes": np.bincount(keys.bucket[keys.times == 1], minlength=1).astype(np.int32).tobytes(),
                        "buckets": asked.column("bucket").to_pylist(), "asked": asked.column("asked").to_pylist(), "keys": asked.column("keys").to_pylist(),
                    }
                ],
                FIRST,
            )

    return map_arrow(rows, PACKS, one)


FIRST = pa.schema(
    [("pack", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("row", pa.binary()), ("pos", pa.binary()), ("known", pa.int32()), ("sizes", pa.binary())]
    + [("buckets", pa.list_(pa.int32())), ("asked", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary()))]
)


def first_found(packs: DataFrame, wide: bool) -> DataFrame:
    """k1, k2, at: the positions of the first level's marks that are met at least twice."""
    none = F.lit(None).cast("binary")
    each = packs.select("pack", F.explode(F.arrays_zip("buckets", "asked", "keys")).alias("x"))
    asked = each.select("pack", F.lit(0).alias("size"), F.col("x.buckets").alias("bucket"), "x.asked", "x.keys", none.alias("counts"), none.alias("times"))
    replies = counting.answers(asked, "bits", wide)

    def one(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            known = counting.bits_in_order(np.frombuffer(r["sizes"], np.int32), r["got"] or [], r["answers"] or [])
            met = np.r_[known, np.ones(r["known"], bool)]
            yield by_row(r["k1"], r["k2"], np.frombuffer(r["row"], np.int32)[met], np.frombuffer(r["pos"], np.int32)[met])

    joined = packs.select("pack", "k1", "k2", "row", "pos", "known", "sizes").join(replies.withColumnRenamed("buckets", "got"), "pack", "left")
    return map_arrow(joined, "k1 long, k2 long, at array<int>", one).dropDuplicates(["k1", "k2"])


def by_row(k1: list[int], k2: list[int], row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """FOUND rows of the marks (row, pos)."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    again = np.r_[False, (row[1:] == row[:-1]) & (pos[1:] == pos[:-1])] if len(row) else np.zeros(0, bool)
    row, pos = row[~again], pos[~again]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    at = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(pos, pa.int32()))
    own = row[starts].tolist()
    return pa.record_batch([pa.array([k1[i] for i in own], pa.int64()), pa.array([k2[i] for i in own], pa.int64()), at], schema=FOUND)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def cut_out(k1: list, k2: list, start: list, raw: np.ndarray, ends: np.ndarray, counts: np.ndarray, left: np.ndarray, window: int):
    """A pack of the stretches in which windows are left: (key, first word in the document, text) of each.

    start: the word at which each text begins in its document; left: the windows that are left of the texts end to end.
    """
    a, b = runs(left)
    if not len(a):
        return None
    first, stops = word_starts(raw, ends), np.cumsum(counts)
    row = np.searchsorted(stops, a, side="right")
    last = b + window - 2
    text_ends = ends[row]
    after = np.minimum(last + 1, len(first) - 1)
    stop = np.where(last + 1 < stops[row], first[after], text_ends)
    blob = raw.tobytes()
    texts = [blob[i:j].decode() for i, j in zip(first[a].tolist(), stop.tolist(), strict=True)]
    begin = np.array(start)[row] + a - (stops - counts)[row]
    own = row.tolist()
    k1, k2 = [k1[i] for i in own], [k2[i] for i in own]
    pack = counting.pack_id(np.array(k1), np.array(k2), begin)
    return pa.RecordBatch.from_pylist([{"pack": pack, "k1": k1, "k2": k2, "start": begin.tolist(), "text": texts, "n": int((last + 1 - a).sum())}], STRETCHES)


STRETCHES = pa.schema([("pack", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("start", pa.list_(pa.int32())), ("text", pa.list_(pa.string())), ("n", pa.int64())])


def stretches(rows: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """Packs of the stretches of windows that the first level leaves: TEXTS."""

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "text", PACK_BYTES):
            raw, ends = raw_texts(part.column("text"))
            words, counts = word_hashes(raw, ends)
            at = part.column("at")
            met = np.zeros(len(words) + 1, bool)
            met[np.repeat(np.cumsum(counts) - counts, np.diff(at.offsets.to_numpy())) + at.flatten().to_numpy()] = True
            stand = marks(words, counts, lengths, 0)[3]
            pack = cut_out(part.column("k1").to_pylist(), part.column("k2").to_pylist(), [0] * len(counts), raw, ends, counts, (stand >= 0) & met[stand], lengths[-1])
            if pack is not None:
                yield pack

    joined = RowMap(found).part(rows, True).join(found, ["k1", "k2"]).select("k1", "k2", "text", "at")
    return map_arrow(joined, TEXTS, one)


def of_pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, ends = raw_texts(pa.array(texts, pa.string()))
    return (raw, ends, *word_hashes(raw, ends))


def asked_by(packs: DataFrame, lengths: list[int], level: int, buckets: int) -> DataFrame:
    def one(batch: pa.RecordBatch):
        for pack, texts in zip(batch.column("pack").to_pylist(), batch.column("text"), strict=True):
            _, h, second, _ = marks(*of_pack(texts.as_py())[2:], lengths, level)
            yield counting.requests(pack, 0, counting.Keys(h, buckets, second))

    return map_arrow(packs.select("pack", "text"), counting.ASKED, one)


def left_of(packs: DataFrame, lengths: list[int], level: int, buckets: int) -> DataFrame:
    """Packs of the stretches of windows that a level leaves; at the last level the windows: k1, k2, at."""
    window, last = lengths[-1], level == len(lengths) - 1
    replies = counting.answers(asked_by(packs, lengths, level, buckets), "bits", last)

    def one(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("k1", "k2", "start", "text", "buckets", "answers")}
            raw, ends, words, counts = of_pack(r["text"])
            own, h, second, stand = marks(words, counts, lengths, level)
            keys = counting.Keys(h, buckets, second)
            met = np.zeros(len(words) + 1, bool)
            met[own[keys.others()]] = True
            met[own[keys.singles()[counting.bits_of(keys, r["buckets"] or [], r["answers"] or [])]]] = True
            if last:
                at = np.flatnonzero(met)
                stops = np.cumsum(counts)
                row = np.searchsorted(stops, at, side="right")
                pos = np.array(r["start"])[row] + at - (stops - counts)[row]
                own, of = numbered(list(zip(r["k1"], r["k2"], strict=True)))  # a document may have several stretches
                yield by_row([a for a, _ in own], [b for _, b in own], of[row], pos)
            else:
                pack = cut_out(r["k1"], r["k2"], r["start"], raw, ends, counts, (stand >= 0) & met[stand], window)
                if pack is not None:
                    yield pack

    joined = packs.select("pack", "k1", "k2", "start", "text").join(replies, "pack", "left")
    return map_arrow(joined, "k1 long, k2 long, at array<int>" if last else TEXTS, one)


def repeats(rows: DataFrame, window: int) -> DataFrame:
    """Where repeated windows of rows (k1, k2, text) start, by key: k1, k2, at (positions)."""
    spark, lengths = rows.sparkSession, levels(window)
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    packs = stored(first_packs(rows, lengths, counting.bucket_count(spark, chars // 80)), "marks")
    found = stored(first_found(packs, len(lengths) == 1), "level0")
    if len(lengths) == 1:
        return found
    packs = stored(stretches(rows, found, lengths), "stretches")
    for level in range(1, len(lengths)):
        last = level == len(lengths) - 1
        n = packs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        left = left_of(packs, lengths, level, counting.bucket_count(spark, n if last else n // 8))
        packs = stored(left.dropDuplicates(["k1", "k2"]) if last else left, f"level{level}")
    return packs


def kept_words(batch: pa.RecordBatch, window: int):
    """All words of each text, and those that no window that starts at its positions (at) covers."""
    at = batch.column("at").to_pylist() if "at" in batch.schema.names else [None] * batch.num_rows
    for text, starts in zip(batch.column("text").to_pylist(), at, strict=True):
        words = text.encode().split()
        if not starts:
            yield words, words
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        edge[np.array(starts)] += 1
        edge[np.array(starts) + window] -= 1
        yield words, [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digests: bool = False) -> DataFrame:
    """Each text without the words that a repeated window covers: id_col, n_words, n_removed, kept (text).

    A window is a run of window words of one text; it is repeated if the same words also start anywhere else,
    the same text and its copies included. Windows are judged on the input. Kept words are joined by one space;
    with digests, kept_sha256 stands for kept. Null and empty texts have no words; null ids and repeated rows
    stay, row by row; other columns are not read; a table without rows gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = keyed(own, "id", "text").select("k1", "k2", "row.id", "row.text")
    found = repeats(rows.select("k1", "k2", "text"), window)
    last = "kept_sha256" if digests else "kept"
    schema = f"id {kind}, n_words long, n_removed long, {last} string"

    def kept(batch: pa.RecordBatch):
        for part in passes(batch, "text"):
            n_words, n_removed, out = [], [], []
            for words, left in kept_words(part, window):
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                joined = b" ".join(left)
                out.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
            yield pa.record_batch([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["id", "n_words", "n_removed", last])

    own_map = RowMap(found)
    sent = own_map.sent

    def untouched(batch: pa.RecordBatch):
        left = batch.filter(pa.array(~hits(sent.value, batch)))
        if left.num_rows:
            yield from kept(left)

    plain = map_arrow(rows.select("id", "text", bit_of().alias("__bit")), schema, untouched)
    cut = map_arrow(own_map.part(rows, True).join(found, ["k1", "k2"], "left").select("id", "text", "at"), schema, kept)
    return plain.unionByName(cut).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """The rows of docs with repeated windows cut from their texts; cases as for remove_repeats.

    A text that loses words becomes the rest, joined by one space, and size_col, where docs has it, its code points; all
    other rows and columns, whatever their names, stay as they are.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeats(rows.select("k1", "k2", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text")), window)
    columns = docs.columns

    def cut(batch: pa.RecordBatch):
        for part in passes(batch, "text"):
            texts = pa.array([b" ".join(left).decode() for _, left in kept_words(part, window)], pa.string())
            own = dict(zip(columns, part.column("row").flatten(), strict=True)) | {text_col: texts}
            if size_col in own:
                own[size_col] = pa.array([len(t) for t in texts.to_pylist()]).cast(own[size_col].type)
            yield pa.record_batch([own[c] for c in columns], columns)

    whole, some = RowMap(found).split(rows)
    joined = some.join(found, ["k1", "k2"], "left")
    same = joined.where("at IS NULL").select("row.*")
    less = joined.where("at IS NOT NULL").select("row", F.col("row").getField(text_col).alias("text"), "at")
    return whole.select("row.*").unionByName(same).unionByName(map_arrow(less, docs.schema, cut))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
