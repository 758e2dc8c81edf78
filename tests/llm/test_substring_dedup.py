import hashlib
import random
from collections import Counter

import pytest

from cellweave.llm import substring_dedup as S


def brute(texts, n):
    words = [(t or "").encode().split() for t in texts]
    met = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for k in range(len(w) - n + 1) if met[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "ab", "ba", "abc", "cab", "x", "Yy"])
    shared = [[word() for _ in range(r.randint(20, 90))] for _ in range(6)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            w += [word() for _ in range(r.randint(0, 50))]
            if r.random() < 0.4:
                p = r.choice(shared)
                a = r.randint(0, 10)
                w += p[a : a + r.randint(25, 90)]
        texts.append(r.choice([" ", "\n", "\t "]).join(w))
    return [*texts, texts[0], texts[5], None, "", "z " * 200, "q " * 36, "q " * 34]


@pytest.mark.parametrize("seed, window", [(1, 35), (2, 35), (3, 12), (4, 9), (5, 50)])
def test_same_words_as_all_windows(spark, monkeypatch, seed, window):
    monkeypatch.setattr(S, "STEP", 64)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeats(df, window=window).collect()}
    for i, (words, kept) in enumerate(zip(*brute(texts, window), strict=True)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode()) == (len(words), len(words) - len(kept), b" ".join(kept))
    digests = {r.doc_id: r.kept_sha256 for r in S.remove_repeats(df, window=window, digests=True).collect()}
    assert all(digests[i] == hashlib.sha256(got[i].kept.encode()).hexdigest() for i in digests)


def test_rows_keep_their_columns(spark, docs_of):
    texts = corpus(9)
    df = docs_of(texts)
    got = {r.doc_id: r for r in S.cut_repeats(df).collect()}
    assert len(got) == len(texts)
    for i, (words, kept) in enumerate(zip(*brute(texts, 35), strict=True)):
        want = texts[i] if len(words) == len(kept) else b" ".join(kept).decode()
        assert got[i].text == want and got[i].n_chars == len(want or "")


def test_awkward_rows(spark, awkward):
    assert S.remove_repeats(awkward).count() == awkward.count()
    assert S.remove_repeats(awkward.limit(0)).count() == 0
    cut = S.cut_repeats(awkward)
    assert cut.columns == awkward.columns
    rest = [c for c in awkward.columns if c not in ("text", "n_chars")]
    assert sorted(map(repr, cut.select(rest).collect())) == sorted(map(repr, awkward.select(rest).collect()))
    other = awkward.withColumnsRenamed({"text": "body", "k1": "text"}).drop("n_chars")
    assert S.cut_repeats(other, text_col="body").columns == other.columns


def test_many_packs_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_BYTES", 700)
    texts = corpus(11)
    rows = [*enumerate(texts), *[(3, texts[3])] * 5, *[(900, " ".join(f"u{i}" for i in range(40)))] * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, len(w), len(w) - len(k), b" ".join(k).decode()) for (i, _), w, k in zip(rows, *brute([t for _, t in rows], 35)))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(df).collect()) == want
