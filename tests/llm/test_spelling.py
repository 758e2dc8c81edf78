"""Operator 12 against all pairs of words, with one leaf and with many, and its trees by themselves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import spelling as sp


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=7, every=31):
    n = Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts(n, seed, stems=12):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéß") for _ in range(r.randint(7, 10))) for _ in range(stems)]
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = r.choice(base[: 1 + int(stems * r.random() ** 3)])
            for _ in range(r.choice((0, 0, 0, 0, 1, 2))):
                k, how = r.randrange(len(w)), r.randrange(3)
                w = w[:k] + r.choice("abcdeéß") * (how != 0) + w[k + (how != 1) :]
            words.append(w if r.random() < 0.9 else w.upper())
        out.append((i, r.choice((" ", "-", "7 ")).join(words)))
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, run string")
    return sorted(tuple(r) for r in sp.variants(df, **more).collect())


@pytest.mark.parametrize("leaf", [1 << 14, 40])
def test_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(sp, "LEAF_WORDS", leaf)
    monkeypatch.setattr(sp, "LEAF_SAMPLE", 4)
    rows = texts(120, 1)
    got = found(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] not in (r[0], r[1]) for r in got)


def test_leaves_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sp, "POINTS", 30)
    monkeypatch.setattr(sp, "VISITORS", 50)
    rows = texts(60, 2)
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "Wordlike wordlike WORDLIKE wordlikes"), (None, "wordlikes ×÷×÷×÷× ×÷×÷×÷×"), (3, "ÀBCDEFGH àbcdefgh ÀBCDEFGH"), (3, "ÀBCDEFGH àbcdefgh ÀBCDEFGH")]
    rows += [(4, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3001)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, "short words")]) == []


def test_ties_and_chain(spark):
    rows = [(1, " ".join(["abcdefgh"] * 200 + ["abcdefg"] * 20 + ["abcdefé"] * 2 + ["zbcdefgh"] * 200 + ["bcdefgh"] * 2))]
    got = found(spark, rows, every=1 << 31)
    assert {r[0]: r[1:3] for r in got} == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdefé": ("abcdefg", "abcdefgh"), "zbcdefgh": (None, "zbcdefgh"), "bcdefgh": ("abcdefgh", "abcdefgh")}


def test_upper_tree_reaches_every_near_leaf():
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(9)) for _ in range(3000)]
    counts = sp.letter_counts(sp.codes_of(words, 9))
    tree = sp.Tree(counts[::3], 40)
    assert tree.leaves > 15
    w, leaf = sp.reached(tree.root, counts, (0, 0))
    home = np.full(len(words), -1)
    home[w] = leaf
    assert (home >= 0).all() and len(w) == len(words)
    w, leaf = sp.reached(tree.root, counts, sp.SAME)
    seen = set(zip(w.tolist(), leaf.tolist(), strict=True))
    i, j = sp.near_of(sp.codes_of(words, 9), sp.codes_of(words, 9))
    assert len(i) > 100 and all((a, home[b]) in seen for a, b in zip(j.tolist(), i.tolist(), strict=True))
    assert len(seen) < 15 * len(words)


def test_range_search_same_as_all_pairs():
    r = random.Random(4)
    nine = sorted({"".join(r.choice("abcdü") for _ in range(9)) for _ in range(2500)})
    eight = sorted({"".join(r.choice("abcdü") for _ in range(8)) for _ in range(1500)})
    points = sp.codes_of(nine, 9)
    for guests in (points, sp.codes_of(eight, 8)):
        a, b = (set(zip(*(x.tolist() for x in f(points, guests)), strict=True)) for f in (sp.range_search, sp.near_of))
        assert a == b and a
