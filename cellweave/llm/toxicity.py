"""Operator 1, toxic spans by a linear-chain conditional random field.

Tokens are runs of letters. Two states, clean and toxic; a token's log-odds of toxic are the summed weights of
its form, prefixes and ending, and a table of transitions ties neighbours. Document labels are all there
is to learn from, so the training tokens are labelled first: a token of a toxic document is toxic if its form or
a prefix of it is met far more often in toxic documents than in clean ones. Forward-backward marginals of the
fitted field then give offending offsets, and their sum and maximum the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Kept, map_arrow, passes, table

#: The training sample: so many documents of each class, in order of a hash of their ids, and characters of each.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 3_000_000
#: A text of more than this share of SAMPLE_CHARS is left out of the sample: one long text does not displace all others.
LONGEST = 20
BITS = 18
ROUNDS = 25
#: Marginals below this are many in a long clean text and add up to nothing.
LIKELY = 0.3
TOKENS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Buckets of a token's features: its form, prefixes of 3 to 5 letters and the last 3."""
    w, mask = word.lower(), (1 << BITS) - 1
    return [zlib.crc32(x.encode()) & mask for x in ("=" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "e" + w[-3:])]


@dataclass
class Field:
    """The fitted field: bucket weights, transition scores (from clean, from toxic; to toxic), start, calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.array([-4.0, -1.0, -4.0]))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))
    base: float = 0.0


def scanned(p: np.ndarray, q: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x[t] = (p[t] + q[t] x[t-1]) / (u[t] + v[t] x[t-1]) from x[-1] = 1, for a long array.

    Blocks of the array are composed side by side, then entered with what the blocks before them give.
    """
    n = len(p)
    if not n:
        return p
    long = max(1, math.isqrt(n) // 2)
    rows = -(-n // long)
    pad = rows * long - n

    def blocks(x, fill):
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(rows, long).T)

    p, q, u, v = blocks(p, 0.0), blocks(q, 1.0), blocks(u, 1.0), blocks(v, 0.0)
    a, b, c, d = q[0], p[0], v[0], u[0]
    for t in range(1, long):
        a, b, c, d = q[t] * a + p[t] * c, q[t] * b + p[t] * d, v[t] * a + u[t] * c, v[t] * b + u[t] * d
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    enter, x = np.empty(rows), 1.0
    for k, (ak, bk, ck, dk) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        enter[k] = x
        x = min(max((ak * x + bk) / (ck * x + dk), 1e-30), 1e30)
    out = np.empty((long, rows))
    x = enter
    for t in range(long):
        x = np.clip((p[t] + q[t] * x) / (u[t] + v[t] * x), 1e-30, 1e30)
        out[t] = x
    return out.T.reshape(-1)[:n]


def marginals(odds: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratios, backward ratios and the marginals of toxic, for documents laid end to end.

    odds: of each token's emission; first: where documents begin, there the chain starts anew.
    """
    from_clean, from_toxic, start = np.exp(moves)
    one = np.ones(len(odds))
    forward = scanned(np.where(first, odds * start, odds * from_clean), np.where(first, 0, odds * from_toxic), one, np.where(first, 0, one))
    after = np.r_[odds[1:], 1.0]
    last = np.r_[first[1:], True]
    back = scanned(one, np.where(last, 0, after * from_toxic)[::-1], one, np.where(last, 0, after * from_clean)[::-1])[::-1]
    ratio = forward * back
    return forward, back, ratio / (1 + ratio)


def labelled_tokens(docs: list[list[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """For each document 1 where a token is taken as toxic. Likely copies, by their least word hash, count once."""
    seen = [Counter(), Counter()]
    parts, met, counted = {}, set(), [0, 0]
    for words, label in zip(docs, toxic.tolist(), strict=True):
        keys, sketch = set(), min((zlib.crc32(w.encode()) for w in words if len(w) > 5), default=-len(met))
        for w in set(words):
            if w not in parts:
                parts[w] = (w, *{w[:k] + "*" for k in (3, 4, 5) if len(w) > k})
            keys.update(parts[w])
        if (label, sketch) not in met:
            met.add((label, sketch))
            seen[label].update(keys)
            counted[label] += 1
    n0, n1 = max(1, counted[0]), max(1, counted[1])
    telling = {k for k, n in seen[1].items() if n >= max(3, 0.02 * n1) and (n + 0.5) / n1 > 12 * (seen[0][k] + 0.5) / n0}
    return [np.array([label == 1 and not telling.isdisjoint(parts[w]) for w in words], np.float64) for words, label in zip(docs, toxic.tolist(), strict=True)]


def document_inputs(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each document 1, the logit of its largest marginal and the logs of one plus the sum of likely ones and of its tokens."""
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    out[:, 3] = np.log1p(sizes)
    out[:, 1] = -12
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        most = np.clip(np.maximum.reduceat(p, starts), 6e-6, 1 - 6e-6)
        out[some, 1] = np.log(most / (1 - most))
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p >= LIKELY, p, 0), starts))
    return out


def fit(texts: list[str], toxic: list[int], share: float) -> Field:
    """The field from labelled texts. share: of toxic documents among all that are labelled, for the score's level.

    Two thirds of the texts fit the field, the rest the score.
    """
    model = Field(base=share)
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return model
    docs = [[w.lower() for w in TOKENS.findall(t)] for t in texts]
    order = {k: np.flatnonzero(y == k) for k in (0, 1)}
    rest = np.zeros(len(y), bool)
    for at in order.values():
        rest[at[2::3]] = True
    own = np.flatnonzero(~rest & np.array([bool(d) for d in docs]))
    if len(own):
        gold = np.concatenate(labelled_tokens([docs[i] for i in own], y[own]))
        words = [w for i in own for w in docs[i]]
        known: dict[str, int] = {}
        at = np.array([known.setdefault(w, len(known)) for w in words])
        table_of = np.array([features(w) for w in known])
        buckets, flat = np.unique(table_of, return_inverse=True)
        flat = flat.reshape(table_of.shape)
        first = np.zeros(len(words), bool)
        first[np.cumsum([0, *(len(docs[i]) for i in own)])[:-1]] = True
        w, seen = np.zeros(len(buckets)), np.full(len(buckets), 1e-3)
        moves, moves_seen = model.moves.copy(), np.full(3, 1e-3)
        both = gold[:-1] + 2 * gold[1:]
        inner = ~first[1:]
        n = np.array([[(inner & (both == s)).sum() for s in (0, 2)], [(inner & (both == s)).sum() for s in (1, 3)]], float)
        for _ in range(ROUNDS):
            odds = np.exp(np.clip(w[flat].sum(1), -30, 30))[at]
            forward, back, p = marginals(odds, first, moves)
            by_word = np.bincount(at, weights=gold - p, minlength=len(known))
            grad = np.bincount(flat.ravel(), weights=np.repeat(by_word, flat.shape[1]), minlength=len(buckets)) - 0.05 * w
            e = np.exp(moves)
            later = odds[1:] * back[1:]
            stay, go = 1.0, e[0] * later
            rise = forward[:-1] * 1.0, forward[:-1] * e[1] * later
            total = stay + go + rise[0] + rise[1]
            g = np.array([n[0, 1] - (go / total)[inner].sum(), n[1, 1] - (rise[1] / total)[inner].sum(), gold[first].sum() - p[first].sum()]) - 0.5 * (moves + 3)
            seen += grad**2
            moves_seen += g**2
            w += 0.6 * grad / np.sqrt(seen)
            moves = np.clip(moves + 0.3 * g / np.sqrt(moves_seen), -12, 6)
        model.weights[buckets] = w
        model.moves = moves
    held = np.flatnonzero(rest)
    if len(np.unique(y[held])) < 2:  # too few labels to set any apart
        held = np.arange(len(y))
    model.scale = logistic(inputs_of([docs[i] for i in held], model), y[held], share)
    return model


def inputs_of(docs: list[list[str]], model: Field) -> np.ndarray:
    sizes = np.array([len(d) for d in docs], np.int64)
    score = {w: float(model.weights[features(w)].sum()) for d in docs for w in d}
    odds = np.exp(np.clip(np.array([score[w] for d in docs for w in d]), -30, 30))
    first = np.zeros(len(odds), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return document_inputs(marginals(odds, first, model.moves)[2], sizes)


def logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Newton's method, with classes weighted as they are among all labels."""
    have = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, share / have, (1 - share) / (1 - have))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.01 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
        b += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Fit the field on a bounded sample of the rows of labels whose crc32 of the id as text is no multiple of 5.

    The sample has sample_docs documents of each class at most, the first by a hash of their ids, as long as
    they have sample_chars characters together; texts of over a LONGEST-th of that are left out. Of rows that repeat an
    id the shortest text counts, once. Rows with a null id or label, and ids that docs lack, count for nothing.
    Without both classes every score is the share of toxic labels.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(id AS string)) % 5 != 0")
    known = known.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Field()
    rank = F.xxhash64(F.col("id").cast("string"), F.lit(1))
    picked = [known.where(F.col("toxic") == k).orderBy(rank, "id").limit(sample_docs) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.length(docs[text_col]) <= sample_chars // LONGEST)
    found = found.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t"))
    order = Window.partitionBy("toxic").orderBy(rank, "id")
    found = found.select("id", "toxic", F.col("t.text").alias("text")).withColumn("n", F.row_number().over(order)).withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = found.where(F.col("chars") <= sample_chars).select("id", "toxic", "n", "text").collect()
    rows.sort(key=lambda r: (r.toxic, r.n))
    return fit([r.text for r in rows], [r.toxic for r in rows], counts.get(1, 0) / sum(counts.values()))


def word_odds(words: list[str], m: Field) -> list[float]:
    sums = m.weights[np.array([features(w) for w in words])].sum(1)
    return np.exp(np.clip(sums.astype(np.float64), -30, 30)).tolist()


def scored(texts: list[str], m: Field, kept: Kept):
    """Each text's score, its number of tokens, the first token of each and all marginals. kept: odds of words met."""
    sizes, words = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        own = TOKENS.findall(t)
        sizes[i] = len(own)
        words += own
    known = kept.of(set(words), lambda new: word_odds(new, m))
    odds = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(words), bool)
    first[starts[sizes > 0]] = True
    p = marginals(odds, first, m.moves)[2]
    if m.scale.any():
        return 1 / (1 + np.exp(-np.clip(document_inputs(p, sizes) @ m.scale, -30, 30))), sizes, starts, p
    return np.full(len(texts), m.base), sizes, starts, p


def tag(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every whole text's score and toxic spans: id_col, score, predicted, n_tokens, spans.

    spans: start and end (code points) and probability of each token whose marginal is threshold or more.
    A null text counts as empty; texts without letters have the score of no toxic token. Null ids and repeated
    rows stay, row by row; no column but the text is an input. Without rows, none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept()

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            score, sizes, starts, p = scored(texts, sent.value, kept)
            hot = p >= threshold
            some = np.diff(np.r_[0, np.cumsum(hot)][np.r_[starts, len(p)]])
            spans = [[] for _ in texts]
            for i in np.flatnonzero(some).tolist():
                marks = hot[starts[i] : starts[i] + sizes[i]]
                spans[i] = [{"start": x.start(), "end": x.end(), "p": float(p[starts[i] + k])} for k, x in enumerate(TOKENS.finditer(texts[i])) if marks[k]]
            yield pa.record_batch(
                [part.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(sizes), pa.array(spans, SPANS)],
                ["id", "score", "predicted", "n_tokens", "spans"],
            )

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(own, f"id {kind}, score double, predicted int, n_tokens long, spans array<struct<start:int,end:int,p:double>>", one).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below 0.5. Nulls and repeats as for tag.

    A model that learnt nothing, for want of labels of both kinds, rejects nothing.
    """
    if not model.scale.any():
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept()

    def one(batch: pa.RecordBatch):
        for part in passes(batch, text_col):
            score = scored([t or "" for t in part.column(text_col).to_pylist()], sent.value, kept)[0]
            yield part.filter(pa.array(score < 0.5))

    return map_arrow(docs, docs.schema, one)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "n_tokens", "spans")
