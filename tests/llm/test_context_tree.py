"""Operator 11 against trees grown one bit at a time, and its estimates by themselves."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.llm import context_tree as ct

DEPTH = ct.DEPTH


def seen(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    return words, "".join(w + " " for w in words).encode() + b"\n"


def held_out(i, every=10):
    return i is None or zlib.crc32(str(i).encode()) % every == 0


class Plain:
    """One tree for each decision: counts by context, mixtures by recursion."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.memo = {}
        for t in texts:
            for context, which, bit in self.steps(t):
                for d in range(DEPTH + 1):
                    self.counts[which, context[:d]][bit] += 1
                    if d:
                        self.children[which, context[: d - 1]].add(context[:d])

    @staticmethod
    def steps(t):
        whole = b"\n" * DEPTH + t
        for i in range(DEPTH, len(whole)):
            context, which = bytes(reversed(whole[i - DEPTH : i])), 1
            for k in range(7, -1, -1):
                bit = whole[i] >> k & 1
                yield context, which, bit
                which = which << 1 | bit

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def logs(self, which, context):
        key = which, context
        if key not in self.memo:
            own = self.kt(*self.counts.get(key, (0, 0)))
            if len(context) == DEPTH:
                self.memo[key] = own, 1.0
            else:
                below = sum(self.logs(which, c)[0] for c in self.children.get(key, ()))
                both = np.logaddexp(own, below) + math.log(0.5)
                self.memo[key] = both, math.exp(own + math.log(0.5) - both)
        return self.memo[key]

    def one(self, which, context, d=0):
        a, b = self.counts.get((which, context[:d]), (0, 0))
        estimate, own = (b + 0.5) / (a + b + 1), self.logs(which, context[:d])[1]
        return estimate if d == DEPTH else own * estimate + (1 - own) * self.one(which, context, d + 1)

    def score(self, t):
        total = 0.0
        for context, which, bit in self.steps(t):
            p = self.one(which, context)
            total += math.log10(p if bit else 1 - p)
        return total


def brute(rows):
    parts = [(i, *seen(t)) for i, t in rows]
    plain = Plain([b for i, _, b in parts if not held_out(i)])
    counts = Counter(w for i, words, _ in parts if not held_out(i) for w in (*words, None))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held_out(i), len(words) + 1, sum(counts[w] > 0 for w in (*words, None)), len(b), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in (*words, None)), plain.score(b))
        for i, words, b in parts
    ]


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcé漢 "[:5]) for _ in range(r.randint(1, 5))) for _ in range(25)]
    return [(i, r.choice((" ", "\n ", "\t")).join(r.choice(words) if r.random() < 0.7 else r.choice(words).upper() for _ in range(r.randint(0, 25)))) for i in range(n)]


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, id string, pack int, score string").repartition(3)
    names = "doc_id held_out n_tokens n_known n_bytes train_tokens base_score score".split()
    return [tuple(r[c] for c in names) for r in ct.log_scores(df, **more).collect()]


def same(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2])

    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    np.testing.assert_allclose([r[6:] for r in got], [r[6:] for r in want], rtol=2e-5, atol=1e-6)


def test_one_bit_at_a_time(spark):
    rows = texts(60, 1)
    assert 0 < sum(held_out(i) for i, _ in rows) < 60
    same(found(spark, rows, shards=7), brute(rows))


def test_small_packs_and_steps(spark, monkeypatch):
    monkeypatch.setattr(ct, "PACK_BYTES", 200)
    rows = texts(30, 2)
    same(found(spark, rows), brute(rows))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b "), (None, "one two one"), (5, "one two one"), (5, "one two one"), (6, "x" * 3000), (7, "é漢字 <|endoftext|> \x1c x")]
    same(found(spark, rows), brute(rows))
    assert found(spark, []) == []
    same(found(spark, [(None, "nothing learnt")]), brute([(None, "nothing learnt")]))


def test_probabilities_of_all_bytes_sum_to_one():
    rng = np.random.default_rng(3)
    keys = ct.grams(np.r_[np.full(DEPTH, 10), rng.choice([97, 98, 99, 32], 4000)].astype(np.uint8), DEPTH)
    keys, counts = ct.summed([keys], [np.ones(len(keys), np.int64)])
    context = keys[100] >> np.uint64(8)
    every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    keys, counts = ct.summed([keys, every], [counts, np.zeros(256, np.int64)])
    columns = [np.concatenate(x) for x in zip(*ct.shard_tops(keys, counts, DEPTH), strict=True)]
    logs = ct.gram_logs(keys, counts, DEPTH, ct.TopTree(*columns))
    assert abs((10 ** logs[np.searchsorted(keys, every)]).sum() - 1) < 1e-9


def test_steps_of_a_pack(monkeypatch):
    blob, sizes = ct.plain_bytes(*(np.frombuffer(b"ab  cD\n\n", np.uint8), np.array([0, 8])), DEPTH)
    assert blob.tobytes() == b"\n" * (2 * DEPTH + 1) + b"ab cd \n" and sizes.tolist() == [DEPTH + 1, DEPTH + 7]
    whole = [k.tolist() for k, *_ in ct.stretches(blob, sizes, DEPTH)]
    monkeypatch.setattr(ct, "STEP", 3)
    for texts in (1, 256):
        parts = list(ct.stretches(blob, sizes, DEPTH, texts))
        assert [x for k, *_ in parts for x in k.tolist()] == whole[0] and len(whole[0]) == 8
        assert [int(o) + f for _, owner, f in parts for o in owner] == [0] + [1] * 7


@pytest.mark.parametrize("x", [0.5, 1.0, 1.5, 7.0, 1000.5, 1e9])
def test_log_gamma(x):
    assert math.isclose(float(ct.log_gamma(np.array([x]))[0]), math.lgamma(x), rel_tol=1e-12, abs_tol=1e-11)


def test_sums_and_packing():
    rng = np.random.default_rng(4)
    sums, every = ct.Sums(), Counter()
    for n in (5, 300, 1, 40, 7):
        k = np.unique(rng.integers(0, 200, n).astype(np.uint64) << np.uint64(50))
        c = rng.integers(0, 9, len(k))
        assert (ct.unpacked_keys(ct.packed_keys(k), len(k)) == k).all() and (ct.restored(ct.squeezed(c), len(c), np.int64) == c).all()
        sums.add(k, c)
        every.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert dict(zip(*(x.tolist() for x in sums.whole()), strict=True)) == dict(every)
